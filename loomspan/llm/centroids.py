"""Exact integer k-means with block-norm screening.

Each vector is compressed once to two numbers a segment: its components' sum and the
norm of what remains when their mean is taken off. By the Cauchy-Schwarz inequality the
product of a vector and a centroid is at most

    sum over segments of (sum of v * sum of c / width + rest of v * rest of c),

so the compressed forms alone give a lower bound of every distance. Centroids whose
bound exceeds the best exact distance so far are pruned; only the others receive exact
integer distances. The bounds are lowered by more than floating point can err, so the
result is that of comparing everything. The driver holds the centroids alone, and a task
sends one row of sums per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import scratch

DIMENSION, CLUSTERS, ROUNDS, SCALE, SEGMENT = 64, 16, 3, 64, 4
#: Integers up to this size have squared distances of `DIMENSION` components that fit in 64 bits.
WIDEST = 1 << 27
#: Vectors that are compared at once.
ROWS = 8192


def segments(values: np.ndarray, width: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(sums, squared norms) of the segments of integer rows; the last may be shorter."""
    starts = np.arange(0, values.shape[1], width)
    return np.add.reduceat(values, starts, axis=1), np.add.reduceat(values * values, starts, axis=1)


def compressed(sums: np.ndarray, squares: np.ndarray, width: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment sums over the root of the width, norms of what a mean leaves, squared norms of rows).

    A shorter last segment counts as filled up with zeros, which changes no product.
    """
    sums, squares = sums.astype(np.float64), squares.astype(np.float64)
    return sums / np.sqrt(width), np.sqrt(np.maximum(squares - sums * sums / width, 0)), squares.sum(1)


def lower_bounds(rows: tuple[np.ndarray, ...], centroids: tuple[np.ndarray, ...]) -> np.ndarray:
    """A bound below each squared distance; errors of rounding are taken off generously."""
    products = rows[0] @ centroids[0].T + rows[1] @ centroids[1].T
    norms = rows[2][:, None] + centroids[2][None, :]
    return norms - 2 * products - (norms * 1e-9 + 1e-6)


def nearest(values: np.ndarray, rows: tuple[np.ndarray, ...], centroids: np.ndarray, packed: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact distances computed) of integer rows; ties go to the smaller number."""
    bounds = lower_bounds(rows, packed)
    first = bounds.argmin(1)

    def exact(at: np.ndarray | slice, c: np.ndarray) -> np.ndarray:
        gap = values[at] - c
        return np.einsum("ij,ij->i", gap, gap)

    best, cluster, computed = exact(slice(None), centroids[first]), first.astype(np.int64), len(values)
    for k in range(len(centroids)):
        open_rows = np.flatnonzero((bounds[:, k] <= best) & (first != k))
        if not len(open_rows):
            continue
        got = exact(open_rows, centroids[k])
        computed += len(open_rows)
        better = (got < best[open_rows]) | ((got == best[open_rows]) & (k < cluster[open_rows]))
        won = open_rows[better]
        best[won], cluster[won] = got[better], k
    return cluster, best, computed


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def _rows(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(n, -1)


def integer_vectors(df: DataFrame, key: str = "vec_id", column: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(key, values, sums, squares): the vectors of exactly `dimension` finite components as floor(scale * x), and their segments.

    Null vectors, other lengths, and vectors with null, NaN or infinite components are
    left out. Rows repeat as they come; a null key stays. A component beyond `WIDEST`
    has no exact 64-bit distances and is an error.
    """
    kind = df.schema[key].dataType.simpleString()
    given = F.col(column).cast("array<double>")
    finite = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = df.where((F.size(given) == dimension) & finite).select(F.col(key).alias("key"), given.alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = np.floor(batch.column(1).flatten().to_numpy() * float(scale))
            if len(floors) and np.abs(floors).max() > WIDEST:
                raise ValueError(f"a component is beyond {WIDEST / scale:.0f}: its distances do not fit in 64 bits")
            values = floors.astype(np.int64).reshape(-1, dimension)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(_lists, (values.astype(np.int32), *segments(values)))], ["key", "values", "sums", "squares"])

    return kept.mapInArrow(run, f"key {kind}, values array<int>, sums array<long>, squares array<long>")


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors of the smallest hashes of their keys, ascending; equal keys by components, null keys last."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("key").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(hashed.asc_nulls_last(), "values").limit(clusters).select("values").collect()  # `clusters` rows
    return np.array([r[0] for r in rows], np.int64)


def _scored(vectors: DataFrame, centroids: np.ndarray, fields: str, emit) -> DataFrame:
    """Every vector with its cluster and distance, as `emit` makes rows of them batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = compressed(*segments(centroids))
        state: dict = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                values, sums, squares = (_rows(batch.column(i), batch.num_rows) for i in (1, 2, 3))
                cluster, distance, computed = nearest(values, compressed(sums, squares), centroids, packed)
                if (out := emit(state, batch, values, cluster, distance, computed)) is not None:
                    yield out
        if (out := emit(state, None, None, None, None, 0)) is not None:
            yield out

    return vectors.mapInArrow(run, fields)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, distance) of every vector."""
    kind = vectors.schema["key"].dataType.simpleString()

    def emit(state, batch, values, cluster, distance, computed):
        if batch is not None:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["key", "cluster", "distance"])

    return _scored(vectors, centroids, f"key {kind}, cluster int, distance long", emit)


def partial_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One row a task and cluster: how many vectors, the sums of their components, exact distances computed."""
    k, width = centroids.shape

    def emit(state, batch, values, cluster, distance, computed):
        if not state:
            state |= {"n": np.zeros(k, np.int64), "sums": np.zeros((k, width), np.int64), "computed": 0}
        if batch is not None:
            state["computed"] += computed
            state["n"] += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                state["sums"][c] += values[cluster == c].sum(0)
            return None
        at = np.flatnonzero(state["n"])
        if not len(at):
            return None
        spent = np.zeros(len(at), np.int64)
        spent[0] = state["computed"]
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(state["n"][at]), _lists(state["sums"][at]), pa.array(spent)], ["cluster", "n", "sums", "computed"])

    return _scored(vectors, centroids, "cluster int, n long, sums array<long>, computed long", emit)


def moved(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """(centroids as exact floors of their vectors' means, exact distances computed); an empty centroid stays."""
    width = centroids.shape[1]
    totals = partial_sums(vectors, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("computed").alias("computed"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    after, computed = centroids.copy(), 0
    for row in totals.collect():  # one row a centroid
        after[row.cluster] = [row[f"s{i}"] // row.n for i in range(width)]
        computed += row.computed
    return after, computed


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after `rounds` rounds."""
    centroids = first_centroids(vectors, clusters)
    for _ in range(rounds if len(centroids) else 0):
        centroids, _computed = moved(vectors, centroids)
    return centroids


def digest(centroid: np.ndarray) -> str:
    """sha256 of a centroid's components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(df: DataFrame, key: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION) -> DataFrame:
    """A row for each kept vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that `integer_vectors` leaves out have no row; repeated rows and null keys
    have one each. Fewer vectors than `clusters` make fewer clusters; none make no rows.
    Other columns are left out, so no name clashes.
    """
    spark = df.sparkSession
    vectors = scratch.materialize(integer_vectors(df, key, column, dimension), "vectors")
    centroids = fit(vectors, clusters, rounds)
    if not len(centroids):
        centroids = np.zeros((1, dimension), np.int64)  # of an empty table, which has no rows to assign
    found = scratch.materialize(assigned(vectors, centroids), "assigned")
    per_cluster = {r.cluster: int(r.inertia) for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # one row a centroid
    total = sum(per_cluster.values())
    facts = spark.createDataFrame([(c, inertia, total, digest(centroids[c])) for c, inertia in per_cluster.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most `clusters` rows are broadcast
    return found.join(F.broadcast(facts), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    kept = """kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    numbered AS (SELECT row_number() OVER () AS r, vec_id, v FROM kept),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS k, v AS c FROM numbered QUALIFY k < 16)"""
    steps = []
    for i in range(4):
        steps.append(f"""d{i} AS (SELECT r, vec_id, v, k, list_sum(list_transform(range(1, 65), lambda i: CAST((v[i] - c[i]) * (v[i] - c[i]) AS HUGEINT))) AS d FROM numbered CROSS JOIN c{i}),
    a{i} AS (SELECT r, vec_id, v, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if i < 3:
            steps.append(f"""p{i} AS (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{i} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i),
    m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM p{i} GROUP BY k),
    c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.k = m{i}.k)""")
    return f"""WITH {kept},
    {''',
    '''.join(steps)}
    SELECT a3.vec_id, CAST(a3.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a3.k) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
    FROM a3 JOIN c3 ON a3.k = c3.k"""


SQL: dict[str, str] = {"op11_centroid_clustering": _sql()}
QUERIES = {"op11_centroid_clustering": op11_centroid_clustering}
