"""Facts and small cases of the operators."""

import random
from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions import calendar as cal
from loomspan.functions import text as tx
from loomspan.operators import chunking, manifests, retrieval


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_window_counts(spark):
    df = spark.createDataFrame([(n,) for n in (0, 800, 801, 1500, 1501)], "n long")
    got = [r.w for r in df.orderBy("n").select(chunking.window_count(F.col("n"), 800, 100).alias("w")).collect()]
    assert got == [0, 1, 2, 2, 3]
    df = spark.createDataFrame([(800, 1000), (1500, 1800)], "n long, b long")
    got = [r.s for r in df.orderBy("n").select(chunking.submitted_tokens(F.col("n"), F.col("b"), 800, 100).alias("s")).collect()]
    assert got == [1001, 1922]


def test_links(spark):
    text = "a HTTP://x.org/a(b)). see (https://y.org/q_(24)), <http://z.com/p?x=1>. http://z.com/p?x=1!"
    assert one(spark, text, tx.links) == ["HTTP://x.org/a(b)", "https://y.org/q_(24)", "http://z.com/p?x=1"]


def test_unreadable(spark):
    assert one(spark, "Unreadable " + "�" * 100, tx.unreadable) is True
    assert one(spark, "fine " * 100, tx.unreadable) is False


def test_path_key(spark):
    assert one(spark, "a b/c~d*e+f%.pdf", tx.path_key) == "a%20b/c~d%2Ae%2Bf%25.pdf"


def test_iso_weeks(spark):
    df = spark.createDataFrame([(date(2021, 1, 3),)], "d date")
    row = df.select(cal.week_label(F.col("d")).alias("w"), cal.monday_of(F.col("d")).alias("m")).first()
    assert (row.w, row.m) == ("2020-W53", date(2020, 12, 28))
    labels = spark.createDataFrame([("2020-W53",), ("2021-W53",), ("x",)], "l string").select(cal.monday_of_label(F.col("l")).alias("m")).collect()
    assert [r.m for r in labels] == [date(2020, 12, 28), None, None]


def model(tokens, most, overlap):
    out, buf = [], []
    for i, n in enumerate(tokens):
        if buf and sum(tokens[j] for j in buf) + n > most:
            out.append((buf[0], i))
            keep, held = [], 0
            for j in reversed(buf):
                keep.insert(0, j)
                held += tokens[j]
                if held >= overlap:
                    break
            buf = keep
        buf.append(i)
    if buf:
        out.append((buf[0], len(tokens)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=30), st.integers(1, 40), st.integers(0, 50))
def test_fold(tokens, most, overlap):
    assert chunking.fold(tokens, most, overlap) == model(tokens, most, overlap)


def test_retrieve_drops_stale_before_it_ranks(spark):
    rows = [(i, "p", "old" if i < 2 else "new", i / 10) for i in range(6)]
    near = spark.createDataFrame(rows, "vec_id long, paper string, revision string, distance double")
    current = spark.createDataFrame([("p", "new")], "paper string, revision string")
    assert [r.vec_id for r in retrieval.retrieve(near, 4, current=current).collect()] == [2, 3]


def test_failures_keep_revision_and_offset(spark):
    old = spark.createDataFrame([("a", "r1", 2, "indexing", None, 1.0)], "paper string, revision string, next_chunk int, state string, error string, updated double")
    bad = spark.createDataFrame([("a", "boom", 2.0), ("b", "boom", 2.0)], "paper string, error string, updated double")
    got = {r.paper: r for r in manifests.record_failures(old, bad, "paper").collect()}
    assert (got["a"].revision, got["a"].next_chunk, got["a"].state) == ("r1", 2, "failed")
    assert (got["b"].revision, got["b"].state, got["b"].updated) == (None, "failed", 2.0)


def test_vectors(spark):
    ok = [([1.0, 0.0], True), ([0.0, 0.0], False), ([float("nan"), 1.0], False), ([1.0], False)]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(ok)], "i int, v array<double>")
    assert [r.x for r in df.orderBy("i").select(retrieval.valid_vector(F.col("v"), 2).alias("x")).collect()] == [b for _, b in ok]


def test_reconcile_takes_only_unique_names(spark):
    waiting = spark.createDataFrame([("a", "n1"), ("b", "n2")], "path string, name string")
    remote = spark.createDataFrame([("n1", "f1"), ("n2", "f2"), ("n2", "f3")], "name string, file_id string")
    assert [tuple(r) for r in manifests.reconcile(waiting, remote, "path").collect()] == [("a", "f1")]
    random.seed(0)
