"""A table with one row for each key, in buckets by a hash of the key.

An upsert rewrites only the buckets that its keys fall in, beside the old ones, and then
commits a root, a small file that names the version of every bucket. Roots are numbered
and made once, so readers see whole versions, and of two writers of one number one starts
again from the other's root; where they touched different buckets nothing is rewritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.sources import sinks

ROOT, BUCKETS, TRIES = "root", 64, 50


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def root_of(spark: SparkSession, where: str) -> tuple[int, dict | None]:
    """(number, root) of the current version; (0, None) before the first."""
    numbers = sinks.numbered(spark, where, ROOT)
    return (numbers[-1], json.loads(sinks.read_text(spark, f"{where}/{ROOT}.{numbers[-1]:012d}"))) if numbers else (0, None)


def _paths(where: str, root: dict, buckets: list[int]) -> list[str]:
    return [f"{where}/data/{root['versions'][str(b)]}/__bucket={b}" for b in buckets if str(b) in root["versions"]]


def read(spark: SparkSession, where: str, schema: str, keys: DataFrame | None = None) -> DataFrame:
    """The rows of the current version; with `keys` (the key columns) only the buckets that these fall in are read, and only their rows come back."""
    _, root = root_of(spark, where)
    empty = spark.createDataFrame([], schema)
    if root is None:
        return empty
    wanted = list(range(root["buckets"]))
    if keys is not None:
        keys = keys.select(*root["keys"]).distinct()
        wanted = sorted(r.b for r in keys.select(bucket_of(root["keys"], root["buckets"]).alias("b")).distinct().collect())  # a number for each bucket
    paths = _paths(where, root, wanted)
    if not paths:
        return empty
    rows = spark.read.schema(schema).parquet(*paths)
    return rows if keys is None else rows.alias("r").join(keys.alias("k"), [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in root["keys"]], "left_semi")


def last_written(changes: DataFrame, keys: list[str], order: Column | None) -> DataFrame:
    """One row for each key: the greatest by `order`, by a hash of the row where that ties; summed up before rows are shuffled, so a key may have any number of them."""
    tie = F.xxhash64(*changes.columns)
    rank = F.struct(tie.alias("t")) if order is None else F.struct(order.alias("o"), tie.alias("t"))
    best = changes.select(*keys, rank.alias("__rank"), F.struct(*changes.columns).alias("__row")).groupBy(*keys).agg(F.max_by("__row", "__rank").alias("__row"))
    return best.select("__row.*")


def upsert(changes: DataFrame, where: str, keys: list[str], order: Column | None = None, buckets: int = BUCKETS, deleted: Column | None = None) -> dict:
    """Replace or add the rows of the changed keys, drop those whose last change is `deleted`; gives the root.

    A key that is changed repeatedly has its last change by `order`. A null is a key like
    any other. The columns of the first upsert stay; `buckets` counts for the first alone.
    No change at all still makes the table.
    """
    spark = changes.sparkSession
    columns = changes.columns
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    last = last_written(changes.withColumn("__gone", gone), keys, order)
    number, root = root_of(spark, where)
    root = root or {"buckets": buckets, "keys": keys, "versions": {}}
    if root["keys"] != keys:
        raise ValueError(f"the table's keys are {root['keys']}")
    fresh = scratch.materialize(last.withColumn("__bucket", bucket_of(keys, root["buckets"])), "changes")
    touched = sorted(r[0] for r in fresh.select("__bucket").distinct().collect())  # a number for each bucket
    merged: dict[str, str] = {}
    based: dict[str, str | None] = {}
    for _ in range(TRIES):
        stale = [b for b in touched if str(b) not in merged or based[str(b)] != root["versions"].get(str(b))]
        if stale:
            version = uuid.uuid4().hex
            part = fresh.where(F.col("__bucket").isin(stale))
            out = part.where("NOT __gone").select(*columns, "__bucket")
            if paths := _paths(where, root, stale):
                schema = changes.schema
                held = spark.read.schema(schema).parquet(*paths).withColumn("__bucket", bucket_of(keys, root["buckets"])).alias("h")
                same = [F.col("h.__bucket") == F.col("c.__bucket"), *(F.col(f"h.{c}").eqNullSafe(F.col(f"c.{c}")) for c in keys)]
                out = held.join(part.select(*keys, "__bucket").alias("c"), same, "left_anti").select(*columns, "__bucket").unionByName(out)
            out.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{where}/data/{version}")
            for b in stale:
                merged[str(b)], based[str(b)] = version, root["versions"].get(str(b))
        made = sinks.existing(spark, [f"{where}/data/{merged[str(b)]}/__bucket={b}" for b in touched])
        versions = {b: v for b, v in root["versions"].items() if b not in merged} | {str(b): merged[str(b)] for b, there in zip(touched, made, strict=True) if there}
        new = {"buckets": root["buckets"], "keys": keys, "versions": versions}
        if sinks.claim(spark, f"{where}/{ROOT}.{number + 1:012d}", json.dumps(new)):
            return new
        number, root = root_of(spark, where)  # another writer was first
    raise RuntimeError(f"{TRIES} other writers were first")


def vacuum(spark: SparkSession, where: str, keep: int = 2) -> int:
    """Delete the roots before the last `keep` and the versions that no kept root names; gives how many versions went. No writer may run meanwhile."""
    numbers = sinks.numbered(spark, where, ROOT)
    kept = [json.loads(sinks.read_text(spark, f"{where}/{ROOT}.{n:012d}")) for n in numbers[-keep:]]
    named = {v for r in kept for v in r["versions"].values()}
    dropped = 0
    for version in sinks.names(spark, f"{where}/data"):
        if version not in named:
            scratch.remove(spark, f"{where}/data/{version}")
            dropped += 1
    for n in numbers[:-keep]:
        scratch.remove(spark, f"{where}/{ROOT}.{n:012d}")
    return dropped
