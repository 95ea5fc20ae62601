"""Keyed tables, the ledger, runs that go on inside a paper, the audit of passages."""

import hashlib
import sys
import threading
import time
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomspan.operators import ledger, manifests, passage_audit, resumable, retrieval
from loomspan.sources import keyed, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module
ROWS = "k string, v long, note string"


def held(spark, where):
    return {r.k: r.v for r in keyed.read(spark, where, ROWS).collect()}


def test_upsert_rewrites_only_its_buckets(spark, tmp_path):
    where = f"file://{tmp_path}/t"
    assert keyed.read(spark, where, ROWS).count() == 0
    rows = [(f"k{i}", i, "a") for i in range(1000)] + [(None, -1, "null")]
    first = keyed.upsert(spark.createDataFrame(rows, ROWS), where, ["k"], buckets=50)
    assert held(spark, where) == {k: v for k, v, _ in rows}
    few = [("k5", 1, "old"), ("k5", 7, "new"), ("k5", 3, "middle"), ("new", 4, ""), (None, -2, "")]
    second = keyed.upsert(spark.createDataFrame(few, ROWS), where, ["k"], order=F.col("v"), buckets=9)
    changed = {b for b in second["versions"] if second["versions"][b] != first["versions"].get(b)}
    assert len(changed) <= 3 and second["buckets"] == 50
    assert held(spark, where) == {k: v for k, v, _ in rows} | {"k5": 7, "new": 4, None: -2}
    some = keyed.read(spark, where, ROWS, spark.createDataFrame([("k5",), ("k5",), (None,), ("none",)], "k string"))
    assert sorted((r.k or "", r.v) for r in some.collect()) == [("", -2), ("k5", 7)]
    before = keyed.read(spark, where, ROWS)  # a reader of the version before
    keyed.upsert(spark.createDataFrame([("k5", 8, "x"), ("k6", 0, "gone")], ROWS), where, ["k"], deleted=F.col("note") == "gone")
    assert held(spark, where)["k5"] == 8 and "k6" not in held(spark, where) and before.where("k = 'k5'").first().v == 7
    assert keyed.vacuum(spark, where, keep=1) == 0 and len(held(spark, where)) == 1001  # every version still has a bucket
    keyed.upsert(spark.createDataFrame(rows, ROWS), where, ["k"])
    assert keyed.vacuum(spark, where, keep=1) >= 1 and held(spark, where) == {k: v for k, v, _ in rows} | {"new": 4}
    keyed.upsert(spark.createDataFrame([], ROWS), where, ["k"])
    assert len(held(spark, where)) == 1002
    with pytest.raises(ValueError, match="keys are"):
        keyed.upsert(spark.createDataFrame([], ROWS), where, ["v"])


def test_a_bucket_may_become_empty(spark, tmp_path):
    where = f"file://{tmp_path}/t"
    keyed.upsert(spark.createDataFrame([("a", 1, "")], ROWS), where, ["k"], buckets=3)
    keyed.upsert(spark.createDataFrame([("a", 1, "")], ROWS), where, ["k"], deleted=F.lit(True))
    assert held(spark, where) == {}
    keyed.upsert(spark.createDataFrame([("a", 2, "")], ROWS), where, ["k"])
    assert held(spark, where) == {"a": 2}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    where = f"file://{tmp_path}/t"
    work = [threading.Thread(target=lambda i=i: keyed.upsert(spark.createDataFrame([(f"w{i}", i, ""), ("shared", i, "")], ROWS), where, ["k"], buckets=4)) for i in range(4)]
    [t.start() for t in work], [t.join() for t in work]
    got = held(spark, where)
    assert {k: v for k, v in got.items() if k != "shared"} == {f"w{i}": i for i in range(4)} and got["shared"] in range(4)


def test_claim_is_made_once(spark, tmp_path):
    made = []
    work = [threading.Thread(target=lambda i=i: made.append(sinks.claim(spark, f"file://{tmp_path}/c/x.1", str(i)))) for i in range(8)]
    [t.start() for t in work], [t.join() for t in work]
    assert sum(made) == 1 and [p.name for p in Path(tmp_path / "c").iterdir()] == ["x.1"]


def test_eight_requests_at_a_limit_for_three(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/l", 3.5)
    outcome = []

    def ask():
        try:
            outcome.append(book.reserve(1.0))
        except ledger.BudgetExceeded:
            outcome.append(None)

    work = [threading.Thread(target=ask) for _ in range(8)]
    [t.start() for t in work], [t.join() for t in work]
    got = [x for x in outcome if x]
    assert len(got) == 3 and len(outcome) == 8 and book.last() == (3, 3.0)
    book.settle(got[0], 0.25, 25, "req")
    book.refund(got[1], "429")
    book.fail(got[2], "timeout")
    with pytest.raises(ValueError):
        book.settle(got[2], float("nan"))
    assert book.last()[1] == pytest.approx(1.25)
    folded = ledger.fold(book.events())
    assert {r.id: (r.cost, r.state) for r in folded.collect()} == {got[0].id: (0.25, "received"), got[1].id: (0.0, "refunded"), got[2].id: (None, "failed")}
    u = ledger.usage(folded).first()
    assert (u.requests, u.accounted, u.unresolved, u.tokens) == (3, 0.25, 1.0, 25) and u.accounted + u.unresolved == book.last()[1]
    for bad in (0, -1, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            ledger.Ledger(spark, f"file://{tmp_path}/l", bad)
    empty = ledger.usage(ledger.fold(ledger.Ledger(spark, f"file://{tmp_path}/none", 1).events())).first()
    assert (empty.requests, empty.accounted, empty.unresolved) == (0, 0.0, 0.0)


class Counted:
    """A model that notes its calls in a file, and fails or refuses where a text says so or after so many calls."""

    dimensions = 3

    def __init__(self, path, stop=None, metered=False):
        self.path, self.stop, self.metered = str(path), stop, metered

    def __call__(self, texts):
        with open(self.path, "a") as f:
            f.write("".join(t + "\n" for t in texts) + "--\n")
        if any("refuse" in t for t in texts):
            raise ledger.Refused("no")
        if any("break" in t for t in texts) or self.stop and Path(self.path).read_text().count("--") >= self.stop:
            raise OSError("broken")
        vectors = [[float(len(t)), 1.0, 2.0] for t in texts]
        return (vectors, sum(map(len, texts))) if self.metered else vectors

    def calls(self):
        return Path(self.path).read_text().count("--\n") if Path(self.path).exists() else 0


def test_cached_vectors_cost_nothing(spark, tmp_path):
    root, book = f"file://{tmp_path}/e", ledger.Ledger(spark, f"file://{tmp_path}/l", 1.0)
    model = Counted(tmp_path / "calls", metered=True)
    rows = spark.createDataFrame([("a", "one"), ("b", "two"), ("b", "two"), ("c", None), (None, "no key"), ("long", "x" * 40_000)], "key string, text string").coalesce(1)
    got = {r.key: (r.state, r.embedding) for r in ledger.embed(rows, root, model, 3, book, 0.001).collect()}
    assert {k: s for k, (s, _) in got.items()} == {"a": "embedded", "b": "embedded", "c": "embedded", "long": "too long"} and got["a"][1] == [3.0, 1.0, 2.0]
    calls, spent = model.calls(), book.last()[1]
    assert calls >= 1 and spent == pytest.approx(0.006)
    again = ledger.embed(rows, root, model, 3, book, 0.001).collect()
    assert {r.key: r.state for r in again if r.key != "long"} == {"a": "cached", "b": "cached", "c": "cached"} and [r.embedding for r in again if r.key == "a"] == [[3.0, 1.0, 2.0]]
    assert model.calls() == calls and book.last()[1] == spent
    with pytest.raises(ledger.BudgetExceeded):
        ledger.embed(spark.createDataFrame([(str(i), "y" * 100) for i in range(20)], "key string, text string"), root, model, 3, book, 0.001)
    assert model.calls() == calls
    refused = ledger.embed(spark.createDataFrame([("r", "refuse")], "key string, text string"), root, model, 3, book, 0.001).collect()
    assert [(r.state, r.embedding) for r in refused] == [("refused", None)] and book.last()[1] == pytest.approx(spent)
    broken = ledger.embed(spark.createDataFrame([("x", "break")], "key string, text string"), root, model, 3, book, 0.001).collect()
    assert [r.state for r in broken] == ["failed"] and book.last()[1] == pytest.approx(spent + 0.037)  # all it had reserved
    u = ledger.usage(ledger.fold(book.events())).first()
    assert u.accounted + u.unresolved == pytest.approx(book.last()[1])


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def paper_rows(spark, *items):
    return spark.createDataFrame([(p, t, s or digest(t or "")) for p, t, s in items], "paper string, text string, sha256 string").coalesce(1)


def test_a_stopped_run_goes_on_in_the_paper(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    text = " ".join(f"w{i}" for i in range(95))
    rows = paper_rows(spark, ("a", text, None), ("b", "tiny", None), ("c", "", None), ("d", "x", "other"))
    model = Counted(tmp_path / "calls", stop=4)  # the second batch ends; the third call breaks
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    with pytest.raises(Exception, match="broken"):
        resumable.index(rows, root, model, "5/0", batch=4)
    state = {r.paper: (r.next_chunk, r.total, r.state, r.error) for r in resumable.progress(spark, root).collect()}
    reached = state["a"][0]
    assert 4 <= reached <= 12 and state["a"][1:3] == (19, "indexing") and state["b"][2] == "ready" and state["c"][3] == "no text to embed" and state["d"][3] == "changed since conversion"
    assert resumable.current_passages(spark, root).where("paper = 'a'").count() == reached
    after = Counted(tmp_path / "after")
    assert resumable.index(rows, root, after, "5/0", batch=4) == -(-(19 - reached) // 4)
    asked = [t for t in Path(after.path).read_text().split("\n") if t and t != "--"]
    assert len(asked) == 19 - reached and asked[0].split()[0] == f"w{reached * 5}"  # nothing that was committed is asked for again
    got = resumable.current_passages(spark, root)
    assert sorted(r.chunk for r in got.where("paper = 'a'").collect()) == list(range(19)) and got.where("paper = 'b'").count() == 1
    done = after.calls()
    assert resumable.index(rows, root, after, "5/0", batch=4) == 0 and after.calls() == done
    changed = paper_rows(spark, ("a", "other words now", None), ("b", "tiny", "wrong"))
    assert resumable.index(changed, root, after, "5/0", batch=4, rounds=0) == 0
    assert resumable.index(changed, root, after, "5/0", batch=4) == 1
    assert [r.document for r in resumable.current_passages(spark, root).orderBy("paper").collect()] == ["other words now", "tiny"]
    assert {r.paper: r.state for r in resumable.progress(spark, root).collect()} == {"a": "ready", "b": "failed", "c": "failed", "d": "failed"}


def test_audit_of_odd_rows(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000)) + " end"
    papers = passage_audit.papers_of(spark.createDataFrame([("p", digest(text), text, "u"), ("q", digest(""), None, None), (None, "x", "t", "u")], "paper string, sha256 string, text string, link string"), F.lit("r"))
    key = hashlib.sha256(b"p").hexdigest()
    records = spark.createDataFrame([("p", "r", 4, 4, "ready")], "paper string, revision string, next_chunk long, total long, state string")
    schema = "id string, paper string, revision string, chunk long, char_start long, char_end long, document string, link string"
    good = [(f"{key}:r:{i}", "p", "r", i, a, b, text[a:b], "u") for i, (a, b) in enumerate([(0, 300), (250, 600), (600, 1000), (1001, 1004)])]
    odd = [(None, None, None, None, None, None, None, None), (f"{key}:r:9", "p", "r", 9, 5, 5, "", "u"), (f"{key}:r:2", "p", "r", 2, 600, 1000, None, "u"), (f"{key}:r:3", "p", "r", 3, -5, 10, "x", "u"), (f"{key}:r:1", "p", "r", 1, 250, 10**12, "x", "u")]
    sound = passage_audit.passages(spark.createDataFrame(good, schema), papers, records)
    assert all(r.problem is None and not r.gap for r in sound.collect())
    checked = {r.paper: r.problem for r in passage_audit.checkpoints(sound, papers, records).collect()}
    assert checked == {"p": None, "q": "checkpoint"}
    told = sorted((r.problem or "", r.chunk or 0) for r in passage_audit.passages(spark.createDataFrame(odd, schema), papers, records).collect())
    assert told == [("number", 9), ("text", 1), ("text", 2), ("text", 3), ("unknown paper", 0)]
    jumped = passage_audit.passages(spark.createDataFrame([good[0], good[2], good[3]], schema), papers, records)
    assert {r.chunk: r.gap for r in jumped.collect()} == {0: False, 2: True, 3: False}
    none = spark.createDataFrame([], schema)
    audited = passage_audit.passages(none, papers.limit(0), records.limit(0))
    empty = passage_audit.report(audited, passage_audit.checkpoints(audited, papers.limit(0), records.limit(0)), records, records).first()
    assert (empty.papers, empty.n_errors, empty.all_ready, empty.all_eligible, empty.errors) == (0, 0, False, False, [])


def test_gaps_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(passage_audit, "BLOCK", 3)
    text = "".join(chr(97 + i % 26) for i in range(500))
    papers = passage_audit.papers_of(spark.createDataFrame([("p", digest(text), text, "u")], "paper string, sha256 string, text string, link string"), F.lit("r"))
    key = hashlib.sha256(b"p").hexdigest()
    records = spark.createDataFrame([("p", 50)], "paper string, total long")
    spans = [(i * 10, i * 10 + 10) for i in range(50)]
    spans[6] = (65, 70)  # the first of its block begins late
    schema = "id string, paper string, revision string, chunk long, char_start long, char_end long, document string, link string"
    stored = spark.createDataFrame([(f"{key}:r:{i}", "p", "r", i, a, b, text[a:b], "u") for i, (a, b) in enumerate(spans)], schema)
    got = passage_audit.passages(stored, papers, records).collect()
    assert [r.chunk for r in got if r.gap] == [6] and all(r.problem is None for r in got)


def test_vectors_without_a_direction(spark):
    rows = [(1, [1.0, 0.0], "p"), (2, None, "p"), (3, [0.0, 0.0], "q"), (4, [float("nan"), 1.0], "q"), (5, [1.0], "q"), (6, [1.0, None], "q"), (7, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, paper string")
    for metric in ("cosine", "l2"):
        got = retrieval.distances(df, [1.0, 0.0], metric)
        assert sorted(r.vec_id for r in got.collect()) == [1, 7]
        assert [r.vec_id for r in retrieval.retrieve(got, 5).collect()] == [1, 7]
    for query in ([0.0, 0.0], [float("nan"), 0.0], []):
        assert retrieval.distances(df, query).count() == 0
    odd = spark.createDataFrame([(1, "p", None), (2, "p", float("nan")), (3, "p", 0.5)], "vec_id long, paper string, distance double")
    assert [r.vec_id for r in retrieval.retrieve(odd, 5).collect()] == [3]
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert retrieval.keyword_scores(blank, ["x"]).count() == 0


def test_current_revisions_scan_vectors_once(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    near = retrieval.distances(vectors, [1.0] * 64).select("vec_id", F.col("label").alias("paper"), F.lit("r").alias("revision"), "distance")
    current = spark.createDataFrame([(1, "r")], "paper int, revision string")
    plan = retrieval.retrieve(near, 3, current=current)._jdf.queryExecution().executedPlan().toString()
    assert "embeddings.parquet" not in plan  # what is left joins the few rows that were written


def test_manifests_of_odd_rows(spark):
    manifest = spark.createDataFrame([("a", "r1", "ready", None, 1), ("b", "r2", "ready", None, 1)], "path string, revision string, state string, error string, updated long")
    failures = spark.createDataFrame([("a", "early", 2), ("a", "late", 3), ("c", "new", 4), (None, "x", 5), ("b", "no time", None)], "path string, error string, updated long")
    got = {r.path: (r.revision, r.state, r.error, r.updated) for r in manifests.record_failures(manifest, failures, "path").collect()}
    assert got == {"a": ("r1", "failed", "late", 3), "b": ("r2", "ready", None, 1), "c": (None, "failed", "new", 4)}
    parents = spark.createDataFrame([("w", 5), ("w", 1)], "k string, mtime long")
    assert [tuple(r) for r in manifests.stale(parents, spark.createDataFrame([("w", 3), ("w", 4)], "k string, mtime long"), "k").collect()] == [("w", 2, False)]
    expected, local = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4), ("e", 5)], "p string, size long"), spark.createDataFrame([("a", 1), ("b", None), ("c", 3), ("e", 6)], "p string, size long")
    assert {r.p: r.problem for r in manifests.inventory_problems(expected, local, "p").collect()} == {"b": "unknown size", "c": "unknown size", "d": "missing", "e": "size"}
    stored = spark.createDataFrame([("a", -1), ("a", 0), ("b", None), ("b", 0), ("c", 0), ("c", 1)], "p string, chunk long")
    totals = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "p string, total long")
    assert {r.p: r.problem for r in manifests.audit(totals, stored, "p").collect()} == {"a": "out of range", "b": "out of range", "c": "ok"}


def test_time_of_one_commit(spark, tmp_path):
    """The log grows, a commit reads its last entry alone."""
    book = ledger.Ledger(spark, f"file://{tmp_path}/l", 1e9)
    began = time.time()
    for _ in range(30):
        book.reserve(1.0)
    assert book.last() == (30, 30.0) and time.time() - began < 30
