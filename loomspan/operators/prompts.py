"""Prompts as columns: sections one after the other, never formatted, since logs hold braces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sections(*parts: tuple[str, Column]) -> Column:
    """Headed sections with an empty line between; a null or empty one is left out with its head."""
    return F.concat_ws("\n\n", *(F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(head + "\n"), body)) for head, body in parts))


def first_of(choices: tuple[tuple[str, Column], ...], default: str) -> Column:
    """The name of the first choice that holds; a null holds not."""
    out = None
    for name, holds in choices:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return F.lit(default) if out is None else out.otherwise(default)
