"""Digests that follow their parts: days, weeks, months, level by level, each only where something changed.

A digest is made of its parts' texts, and what it was made of is kept as a fingerprint. A
level's fingerprints are summed from the texts of the level below as they are by then, so
a change goes up as far as texts change, and no farther: a week that is written again and
comes out as it was changes no month. All levels are rows of one keyed table, of which an
upsert rewrites the touched buckets alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.adapters.models import Completer
from loomspan.functions import calendar as cal
from loomspan.functions.text import usable
from loomspan.operators import digests
from loomspan.operators.context import ordered_join
from loomspan.sources import keyed

ROWS = "kind string, label string, text string, fingerprint string"
LEVELS = ("daily", "weekly", "monthly")


def calendar_parts(days: DataFrame) -> DataFrame:
    """(kind, label, part_kind, part): which days make a week and which weeks a month; a week belongs to every month that it touches."""
    day = days.select("day").where("day IS NOT NULL").distinct()
    weeks = day.select(F.lit("weekly").alias("kind"), cal.week_label(F.col("day")).alias("label"), F.lit("daily").alias("part_kind"), F.col("day").cast("string").alias("part"))
    months = cal.month_weeks(day).select(F.lit("monthly").alias("kind"), F.col("month").alias("label"), F.lit("weekly").alias("part_kind"), cal.week_label(F.col("week_start")).alias("part"))
    return weeks.unionByName(months)


def current(spark: SparkSession, root: str) -> DataFrame:
    """(kind, label, text, fingerprint) of every digest; none before the first run."""
    return keyed.read(spark, root, ROWS)


def run(leaves: DataFrame, parts: DataFrame, root: str, model: Completer, levels: tuple[str, ...] = LEVELS, force: bool = False) -> DataFrame:
    """(kind, label, state) of every digest above the leaves: reused, generated, failed, or dropped where it has no parts any more.

    leaves: label, text of the lowest level; parts: kind, label, part_kind, part, of which a
    digest has few. A digest is written if it is missing, too short to be one, made of other
    parts or texts, or if `force`; one that the model fails on keeps what it had and is
    tried again by the next run. Null texts are empty; of a repeated leaf the greatest text counts.
    """
    spark = leaves.sparkSession
    below = leaves.where("label IS NOT NULL").groupBy("label").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    told = None
    for kind in levels[1:]:
        held = current(spark, root).where(F.col("kind") == kind).select("label", F.col("text").alias("old"), F.col("fingerprint").alias("was"))
        mine = parts.where(F.col("kind") == kind).select("label", F.col("part")).distinct()
        each = mine.join(below.select(F.col("label").alias("part"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "part")
        made = each.groupBy("label").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("part", "digest")))).cast("binary"), 256).alias("fingerprint"))
        both = made.join(held, "label", "full")
        good = usable(F.coalesce("old", F.lit(""))) & F.col("was").eqNullSafe(F.col("fingerprint")) & F.lit(not force)
        state = F.when(F.col("fingerprint").isNull(), "dropped").when(good, "reused").otherwise("generated")
        planned = scratch.materialize(both.select("label", "fingerprint", "old", state.alias("state")), "level")
        stale = planned.where("state = 'generated'").select("label", "state", F.lit(None).cast("string").alias("text"))
        block = F.concat(F.lit("## "), "part", F.lit("\n\n"), "text")
        blocks = each.join(stale.select("label"), "label", "left_semi").groupBy("label").agg(ordered_join(["part"], block, "\n\n").alias("block"))  # texts of what is stale alone
        written = scratch.materialize(digests.build(stale.join(blocks, "label").select("label", "state", "text", "block"), model), "written")
        fresh = written.where("state = 'generated'").join(planned.select("label", "fingerprint"), "label").select(F.lit(kind).alias("kind"), "label", "text", "fingerprint", F.lit(False).alias("__gone"))
        gone = planned.where("state = 'dropped'").select(F.lit(kind).alias("kind"), "label", F.lit("").alias("text"), F.lit("").alias("fingerprint"), F.lit(True).alias("__gone"))
        changes = scratch.materialize(fresh.unionByName(gone), "changes")
        if changes.take(1):
            keyed.upsert(changes.drop("__gone"), root, ["kind", "label"], buckets=8, deleted=F.col("fingerprint") == "")
        out = planned.where("state <> 'generated'").select("label", "state").unionByName(written.select("label", "state")).select(F.lit(kind).alias("kind"), "label", "state")
        told = out if told is None else told.unionByName(out)
        below = current(spark, root).where(F.col("kind") == kind).select("label", "text")
    return told
