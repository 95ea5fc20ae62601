"""Uploads that run, conversions under deadlines, commands."""

import hashlib
import json
import sys
import time
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomspan import cli
from loomspan.adapters import paged
from loomspan.operators import sending

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Folder:
    """A side that keeps what it gets in a folder; names say what goes wrong, and how often."""

    def __init__(self, root):
        self.root = Path(root)

    def _note(self, what, path):
        (self.root / "calls").mkdir(parents=True, exist_ok=True)
        with open(self.root / "calls" / path.replace("/", "_"), "a") as f:
            f.write(what + "\n")
        return (self.root / "calls" / path.replace("/", "_")).read_text().split("\n").count(what)

    def upload(self, path, content):
        n = self._note("upload", path)
        if "refused" in path:
            raise sending.Refused("413")
        if "busy" in path and n < 3:
            raise sending.Busy("429")
        if "lost" in path:
            raise sending.Unknown("timeout")
        (self.root / path).write_bytes(content)
        return path

    def attach(self, file_id, path):
        if self._note("attach", path) == 1 and "detached" in path:
            raise sending.Refused("409")

    def update(self, file_id, path, content):
        self._note("update", path)
        (self.root / path).write_bytes(content)

    def reindex(self, file_id):
        self._note("reindex", file_id)

    def poll(self, file_id):
        n = self._note("poll", file_id)
        return "processing" if n < 2 or "slow" in file_id else "failed" if "bad" in file_id and n < 3 else "ready"


def inputs(spark, **texts):
    rows = [(f"{k}.md", hashlib.sha256(t.encode()).hexdigest(), len(t), not t, bytearray(t.encode())) for k, t in texts.items()]
    return spark.createDataFrame(rows, "path string, sha256 string, size_bytes long, blank boolean, content binary")


def calls(folder, name):
    path = Path(folder) / "calls" / f"{name}.md"
    return path.read_text().split() if path.exists() else []


def test_what_is_sent_is_sent_once(spark, tmp_path):
    root, side = f"file://{tmp_path}/m", str(tmp_path / "side")
    connect = lambda: Folder(side)
    first = inputs(spark, plain="one", busy="two", refused="three", lost="four", detached="five", slow="six", bad="seven", empty="")
    got = {r.path[:-3]: (r.action, r.phase, r.error) for r in sending.run(first, root, connect, at_once=3, wait=0.01, polls=3).collect()}
    assert got["plain"] == ("send", "ready", None) and got["busy"] == ("send", "ready", None) and calls(side, "busy").count("upload") == 3
    assert got["refused"] == ("send", "new", "Refused: 413") and got["empty"][0] == "empty"
    assert got["lost"] == ("send", "uploading", "Unknown: timeout") and got["detached"][1:] == ("uploaded", "Refused: 409")
    assert got["slow"][1:] == ("attached", "not ready in time") and got["bad"][1:] == ("failed", "processing failed")
    again = {r.path[:-3]: (r.action, r.phase, r.error) for r in sending.run(first, root, connect, at_once=2, wait=0.01, polls=3, retry_failed=True).collect()}
    assert again["plain"][0] == "unchanged" and again["lost"][0] == "reconcile" and calls(side, "lost").count("upload") == 1
    assert again["detached"][1:] == ("ready", None) and calls(side, "detached").count("upload") == 1 and calls(side, "detached").count("attach") == 2
    assert again["bad"][1:] == ("ready", None) and "reindex" in calls(side, "bad")
    changed = inputs(spark, plain="one more")
    after = sending.run(changed, root, connect, wait=0.01).first()
    assert (after.action, after.phase) == ("send", "ready") and (Path(side) / "plain.md").read_text() == "one more" and calls(side, "plain").count("upload") == 1
    held = {r.path: r.file_id for r in sending.manifest(spark, root).collect()}
    assert held["plain.md"] == "plain.md" and held["lost.md"] is None and "refused.md" not in held
    assert sending.run(changed.limit(0), root, connect).count() == 0


def test_a_run_that_dies_leaves_what_it_began(spark, tmp_path):
    root = f"file://{tmp_path}/m"

    def broken():
        raise RuntimeError("no connection at all")

    with pytest.raises(Exception, match="no connection"):
        sending.run(inputs(spark, a="x", b="y"), root, broken)
    assert {r.path: r.phase for r in sending.manifest(spark, root).collect()} == {"a.md": "uploading", "b.md": "uploading"}
    got = sending.run(inputs(spark, a="x", b="y"), root, lambda: Folder(str(tmp_path / "side")))
    assert {r.action for r in got.collect()} == {"reconcile"}


def rendered(path, slow=(), broken=()):
    """A renderer that notes its calls; some batches take long, some fail."""

    def render(content, first, end):
        with open(path, "a") as f:
            f.write(f"{first}\n")
        if first in slow:
            time.sleep(30)
        if first in broken:
            raise ValueError("page is damaged")
        return f"{content.decode()} {first}-{end}"

    return render


def test_conversion_goes_on_after_its_deadline(spark, tmp_path):
    root, calls = f"file://{tmp_path}/c", tmp_path / "calls"
    docs = spark.createDataFrame([("d", 90, bytearray(b"D")), ("none", 0, bytearray(b"N")), (None, 5, bytearray(b""))], "doc_id string, pages long, content binary").coalesce(1)
    began = time.time()
    got = {r.doc_id: r for r in paged.convert(docs, root, rendered(calls, slow={40}), deadline=1.0).collect()}
    assert time.time() - began < 25
    assert (got["d"].state, got["d"].batches, got["d"].kept, got["d"].markdown) == ("unfinished", 5, 2, None) and got["d"].error.startswith("deadline")
    assert (got["none"].state, got["none"].error) == ("failed", "no pages")
    failed = {r.doc_id: r for r in paged.convert(docs, root, rendered(calls, broken={60})).collect()}["d"]
    assert (failed.state, failed.kept, failed.error) == ("failed", 3, "page is damaged")
    whole = {r.doc_id: r for r in paged.convert(docs, root, rendered(calls)).collect()}["d"]
    assert whole.state == "ready" and whole.markdown.split("\n\n") == [f"D {a}-{min(a + 20, 90)}" for a in range(0, 90, 20)]
    assert calls.read_text().split() == ["0", "20", "40", "40", "60", "60", "80"]  # nothing that was kept is rendered again
    paged.convert(docs, root, rendered(calls)).collect()
    assert len(calls.read_text().split()) == 7


def run(capsys, *argv):
    assert cli.main(list(argv)) == 0
    return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]


def test_commands(spark, tmp_path, capsys):
    papers, root = str(tmp_path / "papers"), f"file://{tmp_path}/root"
    rows = [("a", "some words of a paper " * 100), ("b", "others"), ("c", "")]
    spark.createDataFrame([(p, t, hashlib.sha256(t.encode()).hexdigest()) for p, t in rows], "paper string, text string, sha256 string").write.parquet(papers)
    assert run(capsys, "resume", papers, root, "--batch", "2", "--rounds", "1") == [{"rounds": 1}]
    told = {r["paper"]: r["state"] for r in run(capsys, "progress", root)}
    assert told == {"a": "indexing", "b": "ready", "c": "failed"}
    run(capsys, "resume", papers, root)
    report = run(capsys, "audit-passages", papers, root)[0]
    assert report["n_errors"] == 1 and report["papers"] == 3 and not report["all_ready"]
    vectors = str(tmp_path / "vectors")
    spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(1.0)).cast("array<float>").alias("embedding")).write.parquet(vectors)
    run(capsys, "vector-index", vectors, f"{root}/v")
    assert run(capsys, "vector-search", f"{root}/v", vectors, "7", "--top-k", "1")[0]["vec_id"] == 7
    pages = str(tmp_path / "pages")
    spark.createDataFrame([(1, "https://x.org/", "<h1>T</h1>")], "page_id long, url string, html string").write.parquet(pages)
    run(capsys, "markdown", pages, str(tmp_path / "md"))
    assert spark.read.parquet(str(tmp_path / "md")).first().markdown == "# T"
    assert run(capsys, "tokens", papers)[0]["tokens"] > 500
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "2024-01-02.log").write_text("x")
    run(capsys, "fetch", "loomspan.sources.remote:folder_day", str(logs), "2024-01-01", "2024-01-02", str(tmp_path / "fetched"))
    assert spark.read.parquet(str(tmp_path / "fetched")).where("raw = 'x'").count() == 1
    assert run(capsys, "ledger", f"{root}/ledger")[0]["requests"] == 0
    assert {r["path"] for r in run(capsys, "remote", "loomspan.sources.remote:folder_listing", str(logs))} == {"2024-01-02.log"}
