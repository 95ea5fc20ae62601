"""Conversion of long documents in batches of pages; finished batches are kept and checked by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import strip
from loomspan.operators.context import ordered_join

PAGES = 20
#: Fixed value: the policy under which an empty batch counts as finished.
EMPTY_POLICY = "legacy-fallback-v1"


def batches(documents: DataFrame, size: int = PAGES) -> DataFrame:
    """(doc_id, first, end): the page ranges of each document; none without pages.

    documents: doc_id, pages.
    """
    starts = F.when(F.col("pages") > 0, F.sequence(F.lit(0).cast("long"), F.col("pages").cast("long") - 1, F.lit(size).cast("long")))
    each = documents.select("doc_id", "pages", F.explode(starts).alias("first"))
    return each.select("doc_id", "first", F.least(F.col("first") + size, F.col("pages").cast("long")).alias("end"))


def intact() -> Column:
    """Whether a kept batch holds the text that its digest names, and is empty only under the policy for that."""
    same = F.sha2(F.col("markdown").cast("binary"), 256) == F.col("sha256")
    filled = (F.length(strip(F.col("markdown"))) > 0) | F.col("empty_policy").eqNullSafe(EMPTY_POLICY)
    return F.coalesce(same & filled, F.lit(False))


def plan(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(doc_id, first, end, state, markdown): `kept` with its text, or `render`.

    cache: doc_id, first, end, markdown, sha256, empty_policy. Damaged rows, and rows of
    other page ranges, count for nothing; of several intact rows for a batch the least text
    is taken, so a batch that two tasks have written does not come twice.
    """
    good = cache.where(intact()).groupBy("doc_id", "first", "end").agg(F.min("markdown").alias("markdown"))
    state = F.when(F.col("markdown").isNull(), "render").otherwise("kept")
    return wanted.join(good, ["doc_id", "first", "end"], "left").select("doc_id", "first", "end", state.alias("state"), "markdown")


def record(rendered: DataFrame) -> DataFrame:
    """Rows to append to the cache from (doc_id, first, end, markdown); a null text is no result and is left out."""
    digest = F.sha2(F.col("markdown").cast("binary"), 256)
    return rendered.where("markdown IS NOT NULL").select("doc_id", "first", "end", "markdown", digest.alias("sha256"), F.lit(EMPTY_POLICY).alias("empty_policy"))


def assemble(planned: DataFrame) -> DataFrame:
    """(doc_id, markdown) of the documents whose batches are all there, with a blank line between batches."""
    whole = planned.groupBy("doc_id").agg(F.count_if(F.col("markdown").isNull()).alias("open"), ordered_join(["first"], F.col("markdown"), "\n\n").alias("markdown"))
    return whole.where("open = 0").select("doc_id", "markdown")
