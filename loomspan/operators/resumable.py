"""Indexing that goes on where it stopped, inside a paper.

A run cuts the papers that are new, changed or unfinished into passages once, and then
embeds them in rounds: the next `batch` passages of every paper. A round writes its
passages under a name of its own and commits, in one upsert of the keyed table of
progress, how far each paper is and which rounds hold its passages. A run that stops
loses the round that it was in, and the next one asks the model for nothing that a
committed round holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.adapters.models import Embedder
from loomspan.functions.text import revision, unreadable
from loomspan.operators import indexing
from loomspan.sources import keyed

PROGRESS = "paper string, revision string, next_chunk long, total long, rounds array<string>, state string, error string"


def progress(spark: SparkSession, root: str) -> DataFrame:
    """How far each paper is: ready, indexing or failed."""
    return keyed.read(spark, f"{root}/progress", PROGRESS)


def current_passages(spark: SparkSession, root: str) -> DataFrame:
    """The committed passages of every paper's revision in progress, with their vectors."""
    schema = f"{indexing.PASSAGES}, id string, embedding array<float>, run string"
    rounds = progress(spark, root).select("paper", "revision", F.explode("rounds").alias("run"))
    if not rounds.take(1):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/passages").join(rounds, ["paper", "revision", "run"], "left_semi")


def index(papers: DataFrame, root: str, model: Embedder, recipe: str = "175/20", batch: int = 1000, rounds: int | None = None) -> int:
    """Index the papers (paper, text, sha256) that are not ready; gives the number of rounds that were committed, at most `rounds`.

    A paper of the revision that progress names goes on at its next chunk; one of another
    revision starts anew, and its old passages are no longer current. A text whose digest
    is not the stated one, a damaged one and one without tokens fail: state and error are
    set, what the paper had stays. One row for each paper is expected; of repeated ones any counts.
    """
    spark = papers.sparkSession
    size, overlap = (int(x) for x in recipe.split("/"))
    text = F.coalesce("text", F.lit(""))
    wanted = papers.where("paper IS NOT NULL").dropDuplicates(["paper"]).select("paper", text.alias("text"), "sha256", revision(recipe, F.coalesce("sha256", F.lit(""))).alias("revision"))
    known = progress(spark, root).select("paper", F.col("revision").alias("__r"), "next_chunk", "total", "rounds", "state")
    both = wanted.join(known, "paper", "left")
    same = F.col("__r").eqNullSafe(F.col("revision"))
    open_papers = both.where(~(same & (F.col("state") == "ready")) | F.col("__r").isNull())
    problem = F.when(~F.sha2(F.col("text").cast("binary"), 256).eqNullSafe(F.col("sha256")), "changed since conversion").when(unreadable(F.col("text")), "unreadable")
    told = open_papers.withColumn("__problem", problem)
    staged = scratch.materialize(
        indexing.passages(told.where("__problem IS NULL"), size, overlap).withColumn("id", F.concat_ws(":", F.sha2(F.col("paper").cast("binary"), 256), "revision", F.col("chunk").cast("string"))), "staged"
    )
    totals = staged.groupBy("paper").agg(F.count("*").alias("__total"))
    told = told.drop("text").join(totals, "paper", "left").withColumn("__problem", F.coalesce("__problem", F.when(F.col("__total").isNull(), F.lit("no text to embed"))))
    told = scratch.materialize(told, "open")
    failed = told.where("__problem IS NOT NULL")
    if failed.take(1):
        keep = F.col("__r").isNotNull()
        rows = failed.select(
            "paper", F.when(keep, F.col("__r")).otherwise(F.col("revision")).alias("revision"), F.coalesce("next_chunk", F.lit(0)).alias("next_chunk"), F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("rounds", F.expr("cast(array() AS array<string>)")).alias("rounds"), F.lit("failed").alias("state"), F.col("__problem").alias("error"),
        )
        keyed.upsert(rows, f"{root}/progress", ["paper"])
    at = told.where("__problem IS NULL").select(
        "paper", "revision", F.when(same, F.col("next_chunk")).otherwise(0).alias("next_chunk"), F.col("__total").alias("total"), F.when(same, F.col("rounds")).otherwise(F.expr("cast(array() AS array<string>)")).alias("rounds")
    )
    left = at.agg(F.max(F.ceil((F.col("total") - F.col("next_chunk")) / batch)).alias("n")).first().n or 0
    todo = min(left, rounds) if rounds is not None else left
    for turn in range(todo):
        run = uuid.uuid4().hex
        begin = F.col("next_chunk") + turn * batch
        now = at.where(begin < F.col("total"))
        pieces = staged.join(now.select("paper", begin.alias("__begin")), "paper").where((F.col("chunk") >= F.col("__begin")) & (F.col("chunk") < F.col("__begin") + batch)).drop("__begin")
        indexing.embedded(pieces, model, min(batch, indexing.ROWS)).write.parquet(f"{root}/passages/run={run}")
        reached = F.least(begin + batch, F.col("total"))
        at = scratch.materialize(at.withColumn("rounds", F.when(begin < F.col("total"), F.concat("rounds", F.array(F.lit(run)))).otherwise(F.col("rounds"))), "reached")
        rows = at.where(begin < F.col("total")).select("paper", "revision", reached.cast("long").alias("next_chunk"), "total", "rounds", F.when(reached == F.col("total"), "ready").otherwise("indexing").alias("state"), F.lit(None).cast("string").alias("error"))
        keyed.upsert(rows, f"{root}/progress", ["paper"])
    return todo
