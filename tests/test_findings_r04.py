"""What the review of round 4 found: each test failed before its fix."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import jaccard_join
from loomspan.plans import registry, reports  # noqa: F401  registers queries


class Rows:
    """Gives back the function that tasks run, in place of running it."""

    sparkSession = sparkContext = property(lambda self: self)
    defaultParallelism = 1

    def select(self, *names):
        return self

    def repartition(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def pairs_of(sets, n, comp, head, buckets):
    """The pairs of buckets (lists of places) by the function that tasks run, and the most memory that it took."""
    at = np.array([i for b in buckets for i in b])
    token = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    sketches = [jaccard_join.sketch(x) for x in sets]
    columns = [token, at * 10, n[at], comp[at], head[at]]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([sketches[i] for i in at], pa.binary())], ["token", "sid", "n", "comp", "head", "sketch"])
    tracemalloc.start()
    try:
        out = list(jaccard_join.cross_pairs(Rows(), 1)(iter([batch.slice(0, 7), batch.slice(7)])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    found = [(a // 10, b // 10) for x in out for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    want = {
        (i, j) for b in buckets for i in b for j in b
        if i < j and comp[i] != comp[j] and head[i] != head[j] and 4 * min(n[i], n[j]) >= 3 * max(n[i], n[j]) and jaccard_join.linked(int(n[i]), int(n[j]), jaccard_join.at_most(sketches[i], sketches[j]))
    }
    return found, want, most


def test_pairs_of_a_large_bucket_take_little_memory(monkeypatch):
    """every pair that had been looked at was kept until its bucket was done."""
    monkeypatch.setattr(jaccard_join, "PAIRS", 1 << 12, raising=False)
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.integers(0, 2**64, 20, dtype=np.uint64)) for _ in range(900)]
    own = np.arange(900)
    found, want, most = pairs_of(sets, np.full(900, 20), own, own, [list(own)])
    assert set(found) == want and most < 8 << 20


def test_pairs_of_buckets_equal_those_compared_one_by_one(monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRS", 50, raising=False)
    monkeypatch.setattr(jaccard_join, "TILE", 300, raising=False)
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 2**64, 400, dtype=np.uint64)
    n = rng.integers(1, 300, 120)
    sets = [np.sort(pool[:k] if i % 3 else rng.permutation(pool)[:k]) for i, k in enumerate(n)]
    buckets = [sorted(rng.choice(120, rng.integers(1, 60), replace=False).tolist()) for _ in range(12)]
    found, want, _ = pairs_of(sets, n, rng.integers(0, 30, 120), rng.integers(0, 30, 120), buckets)
    assert set(found) == want and len(want) > 50
    assert list(jaccard_join.cross_pairs(Rows(), 1)(iter([]))) == []


def equals_sql(spark, folder, name, table, rows, schema):
    """Whether the query gives on these rows what its SQL gives."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, f"file://{folder}").toPandas()[list(want.columns)]
    key = lambda f: sorted(repr(tuple(None if v is None or v != v else v for v in r)) for r in f.astype(object).itertuples(index=False, name=None))
    assert key(got) == key(want)


CUT = ["a &quot", "&quot;b&quot", "c &amp", "&amp;quot", "&copy &copy;", "?x=1&lt=2&gt", "&eacute", "&ampquot; &nbsp", "R&D; &am", "&amp;amp; &middot"]


def test_cut_references_in_texts(spark, tmp_path):
    """a reference that lost its semicolon was decoded, as by a browser."""
    rows = [(i, f"<h1>{t}</h1><p>x {t} y</p>") for i, t in enumerate([*CUT, None, ""])]
    equals_sql(spark, tmp_path, "html_text", "pages", [(i, f"http://x.org/{i}", h) for i, h in rows], "page_id long, url string, html string")


def test_cut_references_in_titles(spark, tmp_path):
    """as in texts; and the query gave an empty title for a null page, where its SQL gives none."""
    rows = [(4 * i + k, f"http://x.org/{i}", t and f"<title>x {t}</title><p>y</p>") for i, t in enumerate([*CUT, None]) for k in (2, 3)]
    equals_sql(spark, tmp_path, "html_title", "pages", rows, "page_id long, url string, html string")


def test_any_text_is_not_a_pdf(spark, tmp_path):
    """null and empty texts, and those with the mark of a PDF, were told as other failures than in the SQL."""
    texts = [None, "", "%PDF-1.4", "%PDF-1.4 /Encrypt", "x %PDF- /Type /Page", "é"]
    equals_sql(spark, tmp_path, "failure_classes", "documents", [(6 * i + k, t) for i, t in enumerate(texts) for k in range(6)], "doc_id long, text string")
