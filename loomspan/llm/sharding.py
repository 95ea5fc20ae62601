"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Shards of similar size form
tiers; when a tier has enough of them, they are merged into files of up to the target size,
each group by a task of its own that reads its files and shuffles nothing; larger files
are split. Merged files stay until no retained version names them. Each append or round ends with one new manifest, a
file that appears by a rename which fails if the version exists; readers take the
highest version and so see a whole state, whatever was lost or left half-written.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan import scratch

TARGET = 64 << 20
#: Ratio of the sizes of neighbouring tiers, and shards that a tier needs before it is merged.
RATIO, FAN_IN = 4, 4
SMALLEST = 64 << 10
ARRIVALS = 4
#: Times the target that a shard may have before it is split; groups of shards that one job merges; versions that stay readable.
SLACK, JOB, RETAIN = 1.5, 256, 10
#: Shards whose facts are broadcast to their rows; more are joined by a shuffle.
FACTS = 200_000


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int

    def tier(self) -> int:
        return tier_of(self.bytes)


def tier_of(size: int) -> int:
    return 0 if size < SMALLEST else 1 + int(math.log(size / SMALLEST, RATIO))


def plan_merges(shards: list[Shard], target: int = TARGET, fan_in: int = FAN_IN) -> list[list[Shard]]:
    """Groups of shards to merge: each tier that has `fan_in` shards below half the target, in runs of up to the target size."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if 2 * s.bytes < target:
            tiers.setdefault(s.tier(), []).append(s)
    groups: list[list[Shard]] = []
    for tier in sorted(tiers):
        members = sorted(tiers[tier], key=lambda s: (s.bytes, s.path))
        if len(members) < fan_in:
            continue
        group, size = [], 0
        for s in members:
            if group and size + s.bytes > target:
                groups.append(group)
                group, size = [], 0
            group.append(s)
            size += s.bytes
        if group:
            groups.append(group)
    return [g for g in groups if len(g) > 1]


class Store:
    """A versioned set of shards below one folder of a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.jvm.Path(self.root).getFileSystem(self.conf)
        self.fs.mkdirs(self.jvm.Path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self.fs.listStatus(self.jvm.Path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """The newest manifest, or an older one; version 0 is the empty store."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        if version == 0:
            return 0, []
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/v{version:012d}.json", wholetext=True).collect())
        return version, [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Publish the state after `base`; fails if another writer has published that version."""
        version = base + 1
        draft = self.jvm.Path(f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "parent": base, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        context = self.jvm.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "Options$Rename"), 0)  # none: never overwrite
        context.rename(draft, self.jvm.Path(f"{self.root}/manifests/v{version:012d}.json"), options)
        return version

    def _written(self, folder: str, df: DataFrame, rows: int | None = None) -> list[Shard]:
        """Write rows, at most `rows` to a file, and tell of the files that have any."""
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows or 0).parquet(folder)
        files = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return [Shard(r.path, r.rows, r.bytes) for r in files.agg(F.count("*").alias("rows")).orderBy("path").collect()]

    def append(self, df: DataFrame) -> int:
        """Add an arrival as shards of its own, at least one for each of its tasks that has rows; an empty arrival changes nothing."""
        version, shards = self.read()
        new = self._written(f"{self.root}/data/{uuid.uuid4().hex}", df)
        return self.commit(version, shards + new) if new else version

    def _rewritten(self, schema: T.StructType, groups: list[list[Shard]], rows: int | None = None) -> list[Shard]:
        """Each group's rows in files of its own, of at most `rows` rows: one task reads the group's files and writes, nothing is shuffled."""
        made: list[Shard] = []
        for i in range(0, len(groups), JOB):  # so many groups to a job
            parts = [self.spark.read.schema(schema).parquet(*(s.path for s in g)).coalesce(1) for g in groups[i : i + JOB]]
            while len(parts) > 1:  # pairwise, so that the plan is not deep
                parts = [a.union(parts[k + 1]) if k + 1 < len(parts) else a for k, a in enumerate(parts) if k % 2 == 0]
            made += self._written(f"{self.root}/data/{uuid.uuid4().hex}", parts[0], rows)
        return made

    def compact(self, schema: T.StructType, target: int = TARGET, fan_in: int = FAN_IN) -> int:
        """Split shards beyond the target, then merge until no tier has enough similar shards; each round is one version. It ends, since each merge leaves fewer shards."""
        version, shards = self.read()
        if large := [s for s in shards if s.bytes > SLACK * target and s.rows > 1]:
            made: list[Shard] = []
            by_parts: dict[int, list[Shard]] = {}
            for s in large:  # equal numbers of rows for files of like size
                by_parts.setdefault(max(1, int(s.rows / math.ceil(s.bytes / target))).bit_length(), []).append(s)
            for some in by_parts.values():
                made += self._rewritten(schema, [[s] for s in some], max(1, min(math.ceil(s.rows / math.ceil(s.bytes / target)) for s in some)))
            gone = {s.path for s in large}
            shards = [s for s in shards if s.path not in gone] + made
            version = self.commit(version, shards)
        while groups := plan_merges(shards, target, fan_in):
            made = self._rewritten(schema, groups)
            gone = {s.path for g in groups for s in g}
            shards = [s for s in shards if s.path not in gone] + made
            version = self.commit(version, shards)
        return version

    def vacuum(self, retain: int = RETAIN, age_seconds: float = 86_400.0) -> list[str]:
        """Drop the manifests before the last `retain`, then delete the data files that no manifest names any more; gives the files' paths.

        Files that no manifest has named yet, of writers at work or crashed, are deleted once they are older than
        the age. Readers of a retained version are never disturbed.
        """
        old = self.versions()[: -max(1, retain)]
        for v in old:
            self.fs.delete(self.jvm.Path(f"{self.root}/manifests/v{v:012d}.json"), False)
        named = {s.path for v in self.versions() for s in self.read(v)[1]}
        limit, gone = time.time() * 1000 - age_seconds * 1000, []
        data = self.jvm.Path(f"{self.root}/data")
        found = self.fs.listFiles(data, True) if self.fs.exists(data) else None
        while found is not None and found.hasNext():
            file = found.next()
            path = file.getPath().toString()
            if path.endswith(".parquet") and file.getModificationTime() < limit and not {path, path.replace("file:/", "file:///", 1)} & named:
                self.fs.delete(file.getPath(), False)
                gone.append(path)
        return gone

    def table(self, schema: T.StructType, version: int | None = None, facts: str = "__shard") -> DataFrame:
        """All rows of a version with their own columns, and one more, named by `facts`, that tells of their shard: its place in the manifest, rows, bytes, tier, version.

        Only that one name must not be among the documents' columns.
        """
        if facts in schema.fieldNames():
            raise ValueError(f"the documents have a column {facts!r}; name another one for the facts")
        version, shards = self.read(version)
        kind = "place int, rows long, bytes long, tier int, version long"
        told = self.spark.createDataFrame([(s.path, (i, s.rows, s.bytes, s.tier(), version)) for i, s in enumerate(shards)], f"path string, facts struct<{kind.replace(' ', ':').replace(',:', ',')}>")
        if not shards:
            empty = T.StructType([*schema.fields, T.StructField(facts, told.schema["facts"].dataType)])
            return self.spark.createDataFrame([], empty)
        rows = self.spark.read.schema(schema).parquet(*(s.path for s in shards))
        rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in schema.fieldNames())).alias("row"), F.col("_metadata.file_path").alias("path"))
        told = F.broadcast(told) if len(shards) <= FACTS else told  # some hundred bytes a shard
        return rows.join(told, "path").select("row.*", F.col("facts").alias(facts))


def shard_documents(docs: DataFrame, root: str, arrivals: int = ARRIVALS, target: int = TARGET) -> Store:
    """Append the documents as arrivals, compacting after each; every column and row, repeated ones too, is kept as it is.

    The arrivals are told apart by a hash of the id (null ids go to one of them). An
    empty table leaves an empty store. No column name is reserved.
    """
    store = Store(docs.sparkSession, root)
    for k in range(arrivals):
        store.append(docs.where(F.expr(f"pmod(xxhash64(doc_id), {arrivals}) = {k}")))
        store.compact(docs.schema, target)
    return store


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the shard of the last manifest that holds it, and a digest of its text as read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = shard_documents(docs, scratch.fresh_path(spark, "shards"))
    kept = store.table(docs.schema)
    facts = {"shard": "place", "shard_rows": "rows", "shard_bytes": "bytes", "tier": "tier", "version": "version"}
    return kept.select("doc_id", *(F.col(f"__shard.{c}").alias(n) for n, c in facts.items()), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


SQL: dict[str, str] = {}
QUERIES = {"op4_sharding": op4_sharding}
