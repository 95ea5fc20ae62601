"""Windows with offsets, and runs of the index."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomspan.adapters.models import HashEmbedder
from loomspan.operators import digests, indexing
from loomspan.streaming import watch

SCHEMA = "paper string, text string, sha256 string"


@pytest.mark.parametrize(("n", "size", "overlap"), [(0, 5, 2), (1, 5, 2), (5, 5, 2), (6, 5, 2), (23, 5, 4), (900, 175, 20)])
def test_offsets(n, size, overlap):
    text = " ".join("w%d" % i for i in range(n))
    got = [text[a:b].split() for a, b in indexing.offsets(text, size, overlap)]
    want = [["w%d" % i for i in range(n)][s : s + size] for s in range(0, n, size - overlap)]
    want = want[: next((k + 1 for k, w in enumerate(want) if w and w[-1] == "w%d" % (n - 1)), 0)]
    assert got == want


def rows(spark, *items):
    return spark.createDataFrame([(p, t, s or hashlib.sha256((t or "").encode()).hexdigest()) for p, t, s in items], SCHEMA)


def test_runs(spark, tmp_path):
    root, model = f"file://{tmp_path}/i", HashEmbedder(8)
    assert indexing.current_passages(spark, root).count() == 0
    indexing.index(rows(spark, ("a", "one two", None), ("b", "three", None), ("c", None, None), ("d", "x", "other")), root, model)
    state = {r.paper: (r.state, r.error, r.run is not None) for r in indexing.manifest(spark, root).collect()}
    assert state == {"a": ("ready", None, True), "b": ("ready", None, True), "c": ("failed", "no text to embed", False), "d": ("failed", "changed since conversion", False)}
    first = {r.paper: r.run for r in indexing.manifest(spark, root).collect()}
    indexing.index(rows(spark, ("a", "one two", None), ("b", "other text", None)), root, model)
    indexing.index(rows(spark, ("b", "newest", "wrong")), root, model)
    state = {r.paper: (r.state, r.run) for r in indexing.manifest(spark, root).collect()}
    assert state["a"] == ("ready", first["a"]) and state["b"][0] == "failed" and state["b"][1] != first["b"]
    held = indexing.current_passages(spark, root).select("paper", "document", F.size("embedding").alias("n")).collect()
    assert sorted(tuple(r) for r in held) == [("a", "one two", 8), ("b", "other text", 8)]


def test_digest_failures(spark):
    parts = spark.createDataFrame([("w1", "d1", None, 1), ("w2", "d2", "t", 5)], "label string, part string, text string, mtime long")
    wholes = spark.createDataFrame([("w2", "x" * 60, None)], "label string, text string, mtime long")
    got = {r.label: (r.state, r.text) for r in digests.build(digests.plan(parts, wholes), lambda _: "short").collect()}
    assert got == {"w1": ("failed", None), "w2": ("failed", None)}


def test_watch_papers(spark, tmp_path):
    source, root = tmp_path / "in", f"file://{tmp_path}/i"
    for texts in (("one", "two"), ("one", "changed")):
        rows(spark, *((f"p{i}", t, None) for i, t in enumerate(texts))).coalesce(1).write.mode("append").parquet(str(source))
        watch.watch_papers(spark.readStream.schema(SCHEMA).parquet(str(source)), root, HashEmbedder(4), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.document for r in indexing.current_passages(spark, root).collect()) == ["changed", "one"]
