"""Digests of periods from the digests of their parts: reuse what is usable and newer than its parts, write the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.adapters.models import Completer, complete
from loomspan.functions.text import usable
from loomspan.operators.context import ordered_join

HEAD = "Digest of "


def plan(parts: DataFrame, wholes: DataFrame, force: bool = False) -> DataFrame:
    """(label, state, text, block): one row for each label that has parts.

    parts: label, part, text, mtime; wholes: label, text, mtime. A whole is reused if it
    is usable and no part is newer; else it is to be written from `block`, its parts in order.
    """
    block = F.concat(F.lit("## "), "part", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    grouped = parts.groupBy("label").agg(F.max("mtime").alias("newest"), ordered_join(["part"], block, "\n\n").alias("block"))
    old = wholes.select("label", F.col("text").alias("old"), F.col("mtime").alias("at"))
    both = grouped.join(old, "label", "left")
    keep = usable(F.coalesce("old", F.lit(""))) & ~(F.col("newest") > F.col("at")) & F.lit(not force)
    state = F.when(keep, "reused").otherwise("generated")
    return both.select("label", state.alias("state"), F.when(keep, F.col("old")).alias("text"), F.when(~F.coalesce(keep, F.lit(False)), F.col("block")).alias("block"))


def build(planned: DataFrame, model: Completer) -> DataFrame:
    """(label, state, text) with the missing texts written; a label that the model fails on has state `failed` and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, state, text, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state == "generated":
                    try:
                        text = complete(HEAD + label + "\n" + block, model)
                    except RuntimeError:
                        state, text = "failed", None
                out.append((label, state, text))
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["label", "state", "text"])

    return planned.select("label", "state", "text", "block").mapInArrow(run, "label string, state string, text string")
