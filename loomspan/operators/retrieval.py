"""Exact vector search, retrieval with revisions and caps, keyword and hybrid search."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.operators.chunking import tiles

#: Distances that a task of a batch search holds at once.
TILE = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def valid_vector(v: Column, dimensions: int) -> Column:
    return (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def distances(vectors: DataFrame, query: list[float], metric: str = "cosine") -> DataFrame:
    """Usable vectors with their distance to one query, an array literal: no join at all.

    Vectors that are null, of another length, not finite or without a direction have no
    distance and are left out, by both metrics; repeated rows stay. A query of that kind
    finds nothing.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    usable = vectors.where(F.coalesce(valid_vector(F.col("embedding"), len(query)), F.lit(False)))
    length = float(np.sqrt(np.dot(query, query))) if len(query) else 0.0
    if not np.isfinite(length) or not length:
        return usable.limit(0).withColumn("distance", F.lit(0.0))
    if metric == "l2":
        return usable.withColumn("distance", squared_l2(F.col("embedding"), q))
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * length
    return usable.withColumn("distance", 1 - F.try_divide(dot(F.col("embedding"), q), norm))


_NAME, _TEXT, _NUMBER = r"[A-Za-z_][A-Za-z0-9_]*", r'"(?:[^"\\]|\\.)*"', r"-?[0-9]+(?:\.[0-9]+)?"
_PART = re.compile(rf"\s*(?:({_NAME})\s*(=|!=|<=|>=|<|>)\s*({_TEXT}|{_NUMBER})|(AND|OR)\b|([()]))", re.IGNORECASE)


def metadata_filter(text: str | None, allowed: set[str]) -> Column:
    """A filter such as `date >= "2024-01-01" AND kind = "page"` as a condition over the allowed columns; no text admits all.

    Texts are in double quotes. AND binds closer than OR; parentheses may group. Anything
    else, and any other column, is an error, so no expression of the caller's reaches SQL.
    """
    if text is None or not text.strip():
        return F.lit(True)
    tokens, at, text = [], 0, text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if m is None:
            raise ValueError(f"cannot read the filter at {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    place = 0

    def peek(word: str) -> bool:
        return place < len(tokens) and (tokens[place][4] or tokens[place][5] or "").upper() == word

    def atom() -> Column:
        nonlocal place
        if place >= len(tokens):
            raise ValueError("the filter ends early")
        m = tokens[place]
        place += 1
        if m[5] == "(":
            inner = chain("OR")
            if not peek(")"):
                raise ValueError("a parenthesis is not closed")
            place += 1
            return inner
        if not m[1]:
            raise ValueError(f"{m[0].strip()!r} is not expected here")
        if m[1] not in allowed:
            raise ValueError(f"no column {m[1]!r} to filter by")
        value = F.lit(re.sub(r"\\(.)", r"\1", m[3][1:-1])) if m[3].startswith('"') else F.lit(float(m[3]) if "." in m[3] else int(m[3]))
        column = F.col(m[1])
        return {"=": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[m[2]]

    def chain(word: str) -> Column:
        nonlocal place
        step = (lambda: chain("AND")) if word == "OR" else atom
        out = step()
        while peek(word):
            place += 1
            out = out | step() if word == "OR" else out & step()
        return out

    out = chain("OR")
    if place < len(tokens):
        raise ValueError(f"{tokens[place][0].strip()!r} is not expected here")
    return F.coalesce(out, F.lit(False))


def retrieve(candidates: DataFrame, k: int = 8, per_paper: int = 2, overfetch: int = 5, current: DataFrame | None = None) -> DataFrame:
    """Nearest k with at most `per_paper` of each paper: over-fetch, drop stale revisions, cap, limit.

    candidates: vec_id, paper, distance [, revision]; current: paper, revision. Ties go by
    vec_id; rows without a distance are no candidates, those without a paper are one paper.
    The over-fetched rows are few: with `current` they are written once, so that the vectors
    are scanned once, and they are what is broadcast, however large `current` is.
    """
    near = candidates.where(F.col("distance").isNotNull() & ~F.isnan("distance")).orderBy("distance", "vec_id").limit(overfetch * k)
    if current is not None:
        near = scratch.materialize(near, "near")
        keys = F.broadcast(near.select("paper", "revision").distinct())  # at most overfetch * k rows
        there = current.select("paper", "revision").join(keys, ["paper", "revision"], "left_semi").distinct()
        near = near.join(there, ["paper", "revision"], "left_semi")
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("paper").orderBy("distance", "vec_id"))).where(F.col("n") <= per_paper)
    return ranked.drop("n").orderBy("distance", "vec_id").limit(k)


def batch_top_k(vectors: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], k: int, block: int = 8192) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest by cosine for each of a stated set of queries.

    queries: query_id, embedding, as a table or a list. They come in blocks of at most `block`; each block is one
    pass in which a task compares tiles of bounded size, whatever the block and the batch, and
    keeps k rows for each query, and then a rank over k rows a task. Vectors
    that are null, of another length or without a direction are neither found nor asked for.
    """
    spark = vectors.sparkSession
    out = dimensions = None
    rows = iter(queries) if isinstance(queries, list) else queries.select("query_id", F.col("embedding").cast("array<double>")).toLocalIterator()
    while held := [(r[0], r[1]) for r in itertools.islice(rows, block)]:
        good = [(i, v) for i, v in held if v is not None and None not in v and np.isfinite(v).all() and any(v)]
        dimensions = dimensions or next((len(v) for _, v in good), None)  # those of the first query that has a direction
        found = _nearest(vectors, [x for x in good if len(x[1]) == dimensions], dimensions or 0, k)
        if len(held) == block:  # more may follow: a block's result is written, so that plans do not grow with the blocks
            found = scratch.materialize(found, "nearest")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, vec_id long, distance double, rank int") if out is None else out


def _least(d: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of each row of d, the lesser key first where they tie, and their keys."""
    if d.shape[1] > k:
        row, at = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])  # k of each row, and what ties with the last
        order = np.lexsort((keys[row, at], d[row, at], row))
        row, at = row[order], at[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, at = row[nth < k].reshape(-1, k), at[nth < k].reshape(-1, k)
        return d[row, at], keys[row, at]
    return d, keys


def _nearest(vectors: DataFrame, queries: list[tuple[int, list[float]]], n: int, k: int) -> DataFrame:
    ids, matrix = np.array([i for i, _ in queries], np.int64), np.array([v for _, v in queries], np.float64).reshape(len(queries), n)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    handle = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = handle.value
        if not len(ids):
            return
        best, names = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
        for part in tiles(batches, max(k, TILE // len(ids))):
            keys = part.column(0).to_numpy()
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
            d = 1 - matrix @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            best, names = _least(np.concatenate((best, d), 1), np.concatenate((names, np.broadcast_to(keys, d.shape)), 1), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(names.ravel()), pa.array(best.ravel())], ["query_id", "vec_id", "distance"])

    usable = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(valid_vector(F.col("embedding"), n), F.lit(False))) if n else vectors.limit(0)
    local = usable.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, distance double")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id")))
    return ranked.where(F.col("rank") <= k)


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters and digits; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _scores(counted: DataFrame, total: DataFrame, n_terms: int, k1: float, b: float) -> DataFrame:
    """BM25 of rows doc_id, n, t0, t1, ... with one row total, mean, df0, df1, ..."""
    both = counted.crossJoin(F.broadcast(total))  # one row
    score = F.lit(0.0)
    for i in range(n_terms):
        tf, df = F.col(f"t{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("total") - df + 0.5) / (df + 0.5))
        score = score + F.coalesce(F.try_divide(idf * tf * (k1 + 1), tf + k1 * (1 - b + b * F.try_divide("n", "mean"))), F.lit(0.0))
    return both.select("doc_id", score.alias("score")).where("score > 0")


def keyword_scores(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of documents that hold a term: BM25 over lower-case words.

    The texts are read once: their counts of words and terms are written, and both the
    totals and the scores come from those. For many searches see `keyword_index`.
    """
    held = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    counts = held.select("doc_id", F.size("w").alias("n"), *((F.size("w") - F.size(F.array_remove("w", t))).alias(f"t{i}") for i, t in enumerate(terms)))
    counts = scratch.materialize(counts, "terms")
    total = counts.agg(F.count("*").alias("total"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    return _scores(counts, total, len(terms), k1, b)


def keyword_index(docs: DataFrame, root: str, buckets: int = 64) -> None:
    """Write postings (bucket, term, doc_id, tf, n), partitioned by a hash of the term, and the documents' lengths (doc_id, n) below a folder.

    doc_id tells documents apart; a document's repeated words are counted within its row before
    anything is shuffled, and the files of a bucket are sorted by term, so a search reads a few row groups.
    """
    held = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    held.select("doc_id", F.size("w").alias("n")).write.parquet(f"{root}/lengths")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts = [Counter(words) for words in part.column(1).to_pylist()]
                at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
                sizes = np.array([sum(c.values()) for c in counts], np.int32)
                columns = [part.column(0).take(pa.array(at)), pa.array(sizes[at]), pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "term", "tf"])

    runs = held.mapInArrow(run, f"doc_id {kind}, n int, term string, tf long")
    placed = runs.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(term), {buckets}) as int)"))
    # a frequent term's postings are spread over several files of its bucket
    placed = placed.repartition("bucket", F.expr("cast(pmod(xxhash64(doc_id), 8) as int)")).sortWithinPartitions("bucket", "term")
    placed.write.partitionBy("bucket").parquet(f"{root}/postings")


def indexed_scores(spark: SparkSession, root: str, terms: list[str], buckets: int = 64, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """What `keyword_scores` gives, from a written index: only the terms' buckets are read."""
    kinds = spark.range(1).select(*(F.expr(f"cast(pmod(xxhash64({_quoted(t)}), {buckets}) as int)") for t in terms)).first()
    postings = spark.read.parquet(f"{root}/postings").where(F.col("bucket").isin(sorted(set(kinds))) & F.col("term").isin(list(terms)))
    each = postings.groupBy("doc_id", "n").agg(*(F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"t{i}") for i, t in enumerate(terms)))
    each = scratch.materialize(each, "terms")
    whole = spark.read.parquet(f"{root}/lengths").agg(F.count("*").alias("total"), F.avg("n").alias("mean"))
    total = whole.crossJoin(each.agg(*(F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms)))))  # one row each
    return _scores(each, total, len(terms), k1, b)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def reciprocal_ranks(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Fuse ranked lists (doc_id, rank) by reciprocal ranks."""
    whole = None
    for one in lists:
        part = one.select("doc_id", (F.lit(1.0) / (constant + F.col("rank"))).alias("part"))
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("doc_id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def search(mode: str, semantic: Callable[[], DataFrame], keyword: Callable[[], DataFrame], k: int, depth: int = 50, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of the best k by meaning, by words, or by both fused over the first `depth` of each list.

    semantic: gives doc_id, distance; keyword: gives doc_id, score; only what the mode needs is
    called. allowed: the doc_id that a metadata filter admits.
    """
    if mode not in ("semantic", "keyword", "hybrid"):
        raise ValueError(f"unknown search mode {mode!r}")

    def admitted(found: DataFrame) -> DataFrame:
        return found if allowed is None else found.join(allowed.select("doc_id"), "doc_id", "left_semi")

    lists = []
    if mode in ("keyword", "hybrid"):
        lists.append(admitted(keyword()).select("doc_id", F.round("score", 9).alias("score")))
    if mode in ("semantic", "hybrid"):
        lists.append(admitted(semantic()).select("doc_id", (-F.col("distance")).alias("score")))
    if len(lists) == 1:
        return lists[0].orderBy(F.desc("score"), "doc_id").limit(k)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "doc_id")
    tops = [one.orderBy(F.desc("score"), "doc_id").limit(depth).withColumn("rank", F.row_number().over(order)) for one in lists]  # `depth` rows each
    return reciprocal_ranks(tops, k)


def dispatch(backend: str, backends: dict[str, Callable[..., DataFrame]], *args, **kwargs) -> DataFrame:
    """Call the named backend; an unknown name is an error."""
    if backend not in backends:
        raise ValueError(f"unknown backend {backend!r}")
    return backends[backend](*args, **kwargs)
