"""Structured Streaming forms of the polling loops: watch inputs, merge manifests, keep state counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.operators import indexing


def watch_manifest(source: DataFrame, merge, checkpoint: str, seconds: int | None = None):
    """Run `merge(batch, epoch)` on every micro-batch: all that is there, or every `seconds` forever."""
    writer = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def latest_by_key(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key in a batch; applied to batch and manifest alike it is idempotent."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return batch.withColumn("__n", n).where("__n = 1").drop("__n")


def _as_source(path: str) -> str:
    """The path for a stream, which takes folders and patterns: a pattern that only the path itself fits, and not what is beside it under a longer name."""
    head, _, last = path.rstrip("/").rpartition("/")
    return f"{head}/[{last[0]}]{last[1:]}" if last and last[0] not in "[{*?" else path


def state_totals(spark: SparkSession, path: str) -> DataFrame:
    """(state, n, last_event, total) of an event table read as a stream to its end.

    Each micro-batch writes its partial sums under its epoch, so one that runs twice
    after a failure replaces itself; the partial sums are added at the end.
    """
    out = scratch.fresh_path(spark, "totals")
    schema = spark.read.parquet(path).schema

    def merge(batch: DataFrame, epoch: int) -> None:
        sums = batch.groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.sum("value").alias("total"))
        sums.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream = spark.readStream.schema(schema).parquet(_as_source(path))
    watch_manifest(stream, merge, f"{out}-checkpoint").awaitTermination()
    parts = spark.read.schema("state string, n long, last_event long, total double, epoch int").parquet(out)
    return parts.groupBy("state").agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event"), F.round(F.sum("total"), 4).alias("total"))


def watch_papers(source: DataFrame, root: str, model, checkpoint: str, seconds: int | None = None):
    """Index the papers (paper, text, sha256) of a stream; of two texts of a paper in one batch the one with the greater digest stays."""

    def merge(batch: DataFrame, _: int) -> None:
        indexing.index(latest_by_key(batch, ["paper"], "sha256"), root, model)

    return watch_manifest(source, merge, checkpoint, seconds)


def report_progress(source: DataFrame, out: str, checkpoint: str, seconds: int | None = None):
    """Append a JSON line for each micro-batch of state changes (state): how many of each state it brought. One that runs twice writes its line again under its own epoch."""

    def merge(batch: DataFrame, epoch: int) -> None:
        counts = batch.groupBy("state").agg(F.count("*").alias("n"))
        line = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("states"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
        line.coalesce(1).write.mode("overwrite").json(f"{out}/epoch={epoch}")

    return watch_manifest(source, merge, checkpoint, seconds)
