"""Approximate cosine search: two levels of centres, residual product codes, exact re-ranking.

The number of lists grows with the root of the table. Groups of lists are fitted on a
bounded sample on the driver, the lists of each group on a bounded sample of the group in
a task of its own, and the codebooks on a bounded sample of residuals. Every vector is
indexed, under its nearest `spill` lists, by a code of a byte for each segment of what
its list's centre leaves; the codes are Parquet partitions by group, sorted by list. A
query reads the codes of its nearest lists, ranks what they stand for by cosine, and
compares its best candidates exactly with the stored vectors. How many lists a query
needs for a recall is measured on the sample when the index is built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators.retrieval import valid_vector
from loomspan.sources.sinks import write_text

RECALL = 0.96
#: Lists for each root of the number of vectors, and at most: their centres are broadcast.
DENSITY, MOST_LISTS = 4, 1 << 18
#: Vectors that the driver fits on, and a group for each of its lists; the least by a hash of their id.
SAMPLE, SAMPLE_A_LIST = 20_000, 256
#: Vectors of the sample that are taken as queries to measure recall.
TRIALS = 300
SEGMENTS, CODEWORDS, SPILL = 16, 256, 4
#: Candidates that are compared exactly, for each that is wanted; queries that are searched for in one pass.
RERANK, BLOCK = 48, 4096


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimensions))


def _means(x: np.ndarray, count: int, rounds: int = 10, sphere: bool = True) -> np.ndarray:
    """At most `count` centres of the rows, by k-means from rows spread over the sample."""
    centres = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres, sphere)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        moved = sums[n > 0] / n[n > 0, None]
        centres[n > 0] = _unit(moved) if sphere else moved
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, sphere: bool = True) -> np.ndarray:
    scores = x @ centres.T
    return scores.argmax(1) if sphere else (2 * scores - (centres * centres).sum(1)).argmax(1)


@dataclass
class Index:
    """What is held in memory: centres of groups and lists, the group of each list, codebooks, and how many lists a query reads."""

    groups: np.ndarray
    centres: np.ndarray
    group_of: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def dimensions(self) -> int:
        return self.centres.shape[1]

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into segments, zeros at the end."""
        width = self.books.shape[2] * len(self.books)
        return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), len(self.books), -1)

    def lists_for(self, x: np.ndarray, count: int) -> np.ndarray:
        """The nearest lists of unit rows, the nearest first."""
        scores = x @ self.centres.T
        count = min(count, len(self.centres))
        part = np.argpartition(-scores, count - 1, axis=1)[:, :count]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable"), 1)

    def assigned(self, x: np.ndarray, count: int, wide: int = 6) -> np.ndarray:
        """The nearest lists of unit rows among those of the `wide` nearest groups; -1 where these have fewer."""
        if len(self.groups) <= wide:
            return self.lists_for(x, count)
        near = np.argpartition(-(x @ self.groups.T), wide - 1, axis=1)[:, :wide]
        best, found = np.full((len(x), count), -np.inf, np.float32), np.full((len(x), count), -1)
        for g in range(len(self.groups)):
            rows = np.flatnonzero((near == g).any(1))
            lists = np.flatnonzero(self.group_of == g)
            if not len(rows) or not len(lists):
                continue
            scores = np.concatenate((best[rows], x[rows] @ self.centres[lists].T), 1)
            names = np.concatenate((found[rows], np.broadcast_to(lists, (len(rows), len(lists)))), 1)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :count]
            best[rows], found[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
        return found

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """A byte for each segment of what the rows' centres leave."""
        rest = self.padded(x - self.centres[lists])
        return np.stack([_nearest(rest[:, j], self.books[j], sphere=False) for j in range(len(self.books))], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = np.concatenate([self.books[j][codes[:, j]] for j in range(len(self.books))], 1)
        return self.centres[lists] + rest[:, : self.dimensions]


def _sampled(vectors: DataFrame, sample: int) -> np.ndarray:
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()  # `sample` rows
    return _unit(np.array([r.embedding for r in chosen], np.float32)) if chosen else np.zeros((0, 1), np.float32)


def _fit_lists(vectors: DataFrame, groups: np.ndarray, each: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, groups of them): `each` lists a group, fitted in tasks on a bounded sample of the group."""
    most = each * SAMPLE_A_LIST
    share = min(1.0, 2.0 * most * len(groups) / max(total, 1))
    picked = vectors.where(F.pmod(F.xxhash64(F.lit("lists"), "vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    handle = vectors.sparkSession.sparkContext.broadcast(groups)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _nearest(_matrix(batch.column(1), handle.value.shape[1]), handle.value)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column(0), batch.column(1)], ["cell", "rank", "embedding"])

    def fit(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("embedding").combine_chunks(), handle.value.shape[1])
        centres = _means(x, each)
        return pa.table({"cell": pa.array(np.full(len(centres), table.column("cell")[0].as_py(), np.int32)), "centre": pa.array(list(centres), pa.list_(pa.float32()))})

    placed = picked.select(F.xxhash64("vec_id").alias("rank"), "embedding").mapInArrow(place, "cell int, rank long, embedding array<float>")
    ranked = placed.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("rank"))).where(F.col("n") <= most)
    rows = ranked.select("cell", "embedding").groupBy("cell").applyInArrow(fit, "cell int, centre array<float>").collect()  # at most MOST_LISTS rows
    rows.sort(key=lambda r: (r.cell, r.centre))
    return np.array([r.centre for r in rows], np.float32), np.array([r.cell for r in rows], np.int32)


def fit(vectors: DataFrame, k: int = 10, recall: float = RECALL, spill: int = SPILL) -> Index | None:
    """The index of usable vectors (vec_id, embedding), or None if there are none."""
    total = vectors.count()
    x = _sampled(vectors, SAMPLE)
    if not len(x):
        return None
    lists = min(MOST_LISTS, max(1, round(DENSITY * total**0.5)))
    count = max(1, round(lists**0.5))
    groups = _means(x, count)
    centres, group_of = _fit_lists(vectors, groups, -(-lists // len(groups)), total)
    index = Index(groups, centres, group_of, np.zeros((SEGMENTS, 1, -(-x.shape[1] // SEGMENTS)), np.float32), 1)
    rest = index.padded(x - centres[index.assigned(x, 1)[:, 0]])
    index.books = np.stack([_filled(_means(rest[:, j], CODEWORDS, sphere=False)) for j in range(SEGMENTS)])
    index.probes = _probes(index, x, k, recall, spill)
    return index


def _filled(words: np.ndarray) -> np.ndarray:
    """As many codewords for each segment, the last repeated."""
    return np.concatenate((words, np.repeat(words[-1:], CODEWORDS - len(words), 0)))


def _probes(index: Index, x: np.ndarray, k: int, recall: float, spill: int) -> int:
    """The least number of lists in which `recall` of the nearest k of sampled queries lie, searched within the sample.

    The nearest k of all vectors are nearer than those of a sample, and so no harder to find.
    """
    queries = x[:TRIALS]
    exact = np.argpartition(-(queries @ x.T), min(k, len(x)) - 1, axis=1)[:, : min(k, len(x))]
    scores = queries @ index.centres.T
    place = np.empty(scores.shape, np.int64)
    np.put_along_axis(place, np.argsort(-scores, axis=1, kind="stable"), np.arange(scores.shape[1])[None, :], 1)
    owned = index.assigned(x, spill)
    own = owned[exact]  # trial, neighbour, list
    needed = np.take_along_axis(place[:, None, :], np.maximum(own, 0), 2)
    needed = np.where(own < 0, len(index.centres), needed).min(2).ravel()
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors with an id, a direction and the length of the first such one by id."""
    first = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).orderBy("vec_id").select(F.size("embedding").alias("n")).first()
    kept = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(valid_vector(F.col("embedding"), first.n if first else 0), F.lit(False)))
    return kept.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))


def build(vectors: DataFrame, root: str, k: int = 10, recall: float = RECALL, spill: int = SPILL) -> None:
    """Write an index of all usable vectors (vec_id of any type, embedding) below a folder.

    Vectors that are null, of another length, not finite or without a direction, and those
    without an id, are in no index. Repeated rows are stored and found as often as they
    come. A list of many copies is spread over files, so no task writes it alone.
    """
    spark = vectors.sparkSession
    usable(vectors).write.parquet(f"{root}/vectors")
    stored = spark.read.parquet(f"{root}/vectors")
    index = fit(stored, k, recall, spill)
    kind = stored.schema["vec_id"].dataType.simpleString()
    if index is None:
        write_text(spark, f"{root}/index.json", json.dumps({"lists": 0, "key": kind}))
        return
    handle = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = handle.value
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                x = _matrix(batch.column(1), index.dimensions)
                own = index.assigned(x, spill)
                rows, lists = np.nonzero(own >= 0)[0], own[own >= 0]
                codes = index.codes(x[rows], lists)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(index.group_of[lists]), pa.array(lists.astype(np.int32)), packed], ["vec_id", "cell", "list", "code"])

    coded = stored.mapInArrow(run, f"vec_id {kind}, cell int, list int, code binary")
    coded.hint("rebalance", "cell").sortWithinPartitions("cell", "list").write.partitionBy("cell").parquet(f"{root}/codes")
    tables = {"groups": index.groups, "centres": index.centres, "books": index.books.reshape(SEGMENTS * CODEWORDS, -1)}
    for name, rows in tables.items():
        made = [(i, int(index.group_of[i]) if name == "centres" else 0, row.tolist()) for i, row in enumerate(rows)]
        spark.createDataFrame(made, "n int, cell int, row array<float>").coalesce(1).write.parquet(f"{root}/{name}")
    write_text(spark, f"{root}/index.json", json.dumps({"lists": len(index.centres), "probes": index.probes, "spill": spill, "key": kind}))


def load(spark: SparkSession, root: str) -> tuple[Index | None, dict]:
    """The index in memory, and its facts (lists, probes, spill, key)."""
    facts = json.loads(spark.read.option("wholetext", "true").text(f"{root}/index.json").first()[0])
    if not facts["lists"]:
        return None, facts
    rows = {n: sorted(spark.read.parquet(f"{root}/{n}").collect()) for n in ("groups", "centres", "books")}
    matrix = {n: np.array([r.row for r in rows[n]], np.float32) for n in rows}
    books = matrix["books"].reshape(SEGMENTS, CODEWORDS, -1)
    return Index(matrix["groups"], matrix["centres"], np.array([r.cell for r in rows["centres"]], np.int32), books, facts["probes"]), facts


def search(spark: SparkSession, root: str, queries: DataFrame, k: int, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """(query_id, vec_id, distance, rank): the nearest k that the probed lists hold, by exact cosine distance, for each query (query_id long, embedding).

    Ties go to the lesser id. Queries without a direction, or of another length, find
    nothing. Queries come in blocks; tasks keep `rerank * k` candidates a query.
    """
    index, facts = load(spark, root)
    schema = f"query_id long, vec_id {facts['key']}, distance double, rank int"
    if index is None:
        return spark.createDataFrame([], schema)
    good = queries.where(F.coalesce(valid_vector(F.col("embedding"), index.dimensions), F.lit(False))).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out, held = None, []
    for row in good.toLocalIterator():
        held.append((row.query_id, row.embedding))
        if len(held) == BLOCK:
            found = _search(spark, root, index, held, k, probes or index.probes, rerank, schema)
            out, held = (found if out is None else out.unionByName(found)), []
    if held or out is None:
        found = _search(spark, root, index, held, k, probes or index.probes, rerank, schema) if held else spark.createDataFrame([], schema)
        out = found if out is None else out.unionByName(found)
    return out


def _search(spark: SparkSession, root: str, index: Index, queries: list[tuple[int, list[float]]], k: int, probes: int, rerank: int, schema: str) -> DataFrame:
    ids, exact = np.array([i for i, _ in queries], np.int64), _unit(np.array([v for _, v in queries], np.float64))
    near = index.lists_for(exact.astype(np.float32), probes)
    wanted = np.unique(near)
    handle = spark.sparkContext.broadcast((index, ids, exact, near))
    keep = rerank * k
    kind = schema.split("vec_id ")[1].split(",")[0]
    part = f"query int, vec_id {kind}, score float"

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _, exact, near = handle.value
        x = exact.astype(np.float32)
        asks: dict[int, list[int]] = {}
        for q, lists in enumerate(near.tolist()):
            for one in lists:
                asks.setdefault(one, []).append(q)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lists = batch.column(1).to_numpy()
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(lists), -1)
            points = index.decoded(codes, lists)
            points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
            edges = np.flatnonzero(np.diff(lists, prepend=-1, append=-1))
            gathered: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                asking = asks.get(int(lists[a]))
                if asking:
                    scores = np.round(x[asking] @ points[a:b].T, 6)
                    for q, row in zip(asking, scores, strict=True):
                        gathered.setdefault(q, []).append((row, keys[a:b]))
            for q, parts in gathered.items():
                parts += [best[q]] if q in best else []
                scores, names = np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])
                if len(scores) > keep:
                    edge = np.partition(scores, len(scores) - keep)[len(scores) - keep]
                    over = np.flatnonzero(scores > edge)
                    tied = np.flatnonzero(scores == edge)
                    at = np.concatenate((over, tied[np.argsort(names[tied], kind="stable")[: keep - len(over)]]))
                    scores, names = scores[at], names[at]
                best[q] = scores, names
        for q, (scores, names) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q, np.int32)), pa.array(names), pa.array(scores.astype(np.float32))], ["query", "vec_id", "score"])

    codes = spark.read.parquet(f"{root}/codes").where(F.col("cell").isin([int(c) for c in np.unique(index.group_of[wanted])]))
    if len(wanted) <= 1000:  # a filter that reaches the row groups; beyond, tasks pass over lists that nobody asks for
        codes = codes.where(F.col("list").isin([int(x) for x in wanted]))
    local = codes.select("vec_id", "list", "code").mapInArrow(candidates, part)
    merged = local.groupBy("query", "vec_id").agg(F.max("score").alias("score"))  # a vector stands in several lists
    ranked = merged.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= keep)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids, exact, _ = handle.value
        for batch in batches:
            if batch.num_rows:
                q = batch.column(0).to_numpy()
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(q), -1)
                d = 1 - np.einsum("ij,ij->i", exact[q], x) / np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), batch.column(1), pa.array(d)], ["query_id", "vec_id", "distance"])

    pairs = spark.read.parquet(f"{root}/vectors").join(ranked.select("query", "vec_id"), "vec_id").select("query", "vec_id", "embedding")
    found = pairs.mapInArrow(compare, f"query_id long, vec_id {kind}, distance double")
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return top.select("query_id", "vec_id", "distance", "rank")


def quality(found: DataFrame, exact: DataFrame, facts: dict, k: int) -> DataFrame:
    """One row (queries, recall, share): of the exact nearest k how many were found, by distance so that ties count, and the share of the lists that a query read.

    A found row counts if its exact distance is no farther than the exact k-th.
    """
    last = exact.groupBy("query_id").agg(F.max("distance").alias("edge"), F.count("*").alias("wanted"))
    near = found.join(last, "query_id").where(F.col("distance") <= F.col("edge") + 1e-9).groupBy("query_id").agg(F.count("*").alias("got"))
    both = last.join(near, "query_id", "left")
    share = facts.get("probes", 0) / max(facts["lists"], 1)
    return both.agg(F.count("*").alias("queries"), (F.sum(F.least(F.coalesce("got", F.lit(0)), "wanted")) / F.sum("wanted")).alias("recall")).withColumn("share", F.lit(share))
