"""Ordered text blocks: retrieved context, digests, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_join(order: list[str], text: Column, separator: str) -> Column:
    """Texts of a group joined in order; sorted inside the group, no other row's order matters."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("__text"))))
    return F.array_join(F.transform(rows, lambda x: x["__text"]), separator)


def numbered_context(passages: DataFrame, key: str, order: list[str], header: Column, text: Column, separator: str = "\n\n---\n\n") -> DataFrame:
    """(key, context): passages of each group as `[i] header` blocks, numbered from 1."""
    rows = F.array_sort(F.collect_list(F.struct(*order, header.alias("__head"), text.alias("__text"))))
    blocks = F.transform(rows, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["__head"], F.lit("\n"), x["__text"]))
    return passages.groupBy(key).agg(F.array_join(blocks, separator).alias("context"))


def _scored(score: Column) -> Column:
    return F.when(score.isNull(), "?").otherwise(F.format_string("%.4f", score))


def passage_header(passage: dict[str, Column], score: Column) -> Column:
    """The header of a passage by the first of its metadata that is there: file, date, source_type, filename; else the score alone."""
    none = F.lit(None).cast("string")
    file, date, kind, name = (passage.get(k, none) for k in ("file", "date", "source_type", "filename"))
    start, end = (F.coalesce(passage.get(k, none).cast("string"), F.lit("?")) for k in ("start", "end"))
    told = _scored(score)
    return (
        F.when(file.isNotNull(), F.concat(F.lit("[From "), file, F.lit(" lines "), start, F.lit("-"), end, F.lit("]")))
        .when(date.isNotNull(), F.concat(F.lit("[Date: "), date.cast("string"), F.lit(", Score: "), told, F.lit("]")))
        .when(kind.isNotNull(), F.concat(F.lit("[Source: "), kind, F.lit(", File: "), F.coalesce(name, F.lit("unknown")), F.lit(", Score: "), told, F.lit("]")))
        .when(name.isNotNull(), F.concat(F.lit("[Source: "), name, F.lit(", Score: "), told, F.lit("]"))).otherwise(F.concat(F.lit("[Score: "), told, F.lit("]")))
    )


def format_context(passages: DataFrame, keys: list[str], order: list[str], header: Column, text: Column) -> DataFrame:
    """(keys, context): headed passages of each group in order, with an empty line between. A group is one answer's context, so it is small."""
    block = F.concat(header, F.lit("\n"), F.coalesce(text, F.lit("")))
    return passages.groupBy(*keys).agg(ordered_join(order, block, "\n\n").alias("context"))


def link_block(url: Column, title: Column, kind: Column, error: Column, text: Column) -> Column:
    """What is known of a link, one line for each thing, without what is missing; the kind only if it is no page."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.concat_ws(
        "\n", F.concat(F.lit("URL: "), url), F.when(~blank(title), F.concat(F.lit("Title: "), title)), F.when(~blank(kind) & (kind != "html"), F.concat(F.lit("Type: "), kind)),
        F.when(~blank(error), F.concat(F.lit("Note: "), error)), F.when(~blank(text), F.concat(F.lit("Extracted text:\n"), text)),
    )


def catalog_search(items: DataFrame, text: str = "", kind: str | None = None, sort: str = "title", descending: bool = False) -> DataFrame:
    """Items of a kind whose fields hold a text in any case, sorted by a field and then by label."""
    if kind is not None:
        items = items.where(F.col("kind") == kind)
    if text:
        items = items.where(F.contains(F.lower(F.concat_ws(" ", *(c for c in ("kind", "label", "title", "start", "end") if c in items.columns))), F.lit(text.lower())))
    return items.orderBy(F.col(sort).desc() if descending else F.col(sort), "label")
