"""Sources, sinks, uploads, citations, adapters, the command line."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from loomspan import cli
from loomspan.adapters import models, search_http
from loomspan.operators import citations, uploads
from loomspan.plans import catalogue
from loomspan.sources import files, sinks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "raw", [b"", "grüß \U0001f600".encode(), b"\xef\xbb\xbfx", b"\x91quoted\x92 \x80", b"a\x81b\x91", bytes(b for b in range(128, 256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))]
)
def test_decoded(spark, raw):
    try:
        want = raw.decode("utf-8")
    except UnicodeDecodeError:
        try:
            want = raw.decode("cp1252")
        except UnicodeDecodeError:
            want = raw.decode("latin-1")
    df = spark.createDataFrame([(bytearray(raw),)], "c binary")
    assert df.select(files.decoded(F.col("c"))).first()[0] == want


def test_day_logs_and_preprocess(spark, tmp_path):
    logs = tmp_path / "raw"
    logs.mkdir()
    (logs / "2024-01-02.log").write_bytes("12:00 <a> grün\n12:01 <b> hi {x}\nnoise\n".encode("cp1252"))
    (logs / "2024-02-30.log").write_text("12:00 <a> no such day")
    (logs / "other.log").write_text("12:00 <a> no day")
    (logs / ".hidden.log").write_text("x")
    assert [(str(r.day), "grün" in r.raw) for r in files.day_logs(spark, str(logs)).collect()] == [("2024-01-02", True)]
    out = tmp_path / "chunks"
    cli.preprocess(spark, str(logs), str(out), 60, 12)
    (line,) = [json.loads(x) for f in out.glob("*.json") for x in f.read_text().splitlines()]
    assert line == {"file": "2024-01-02", "index": 0, "start": 0, "end": 2, "text": "grün\nhi {x}"}


def test_digests(spark, tmp_path):
    for kind, label, text in (("daily", "2024-01-02", "d" * 60), ("weekly", "2020-W53", "w"), ("weekly", "2021-W53", "none"), ("monthly", "2024-02", "m" * 60), ("monthly", "2024-13", "none")):
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / f"{label}.md").write_text(text)
    found = {(r.kind, r.label, str(r.start), str(r.end)) for r in files.digests(spark, str(tmp_path)).collect()}
    assert found == {("daily", "2024-01-02", "2024-01-02", "2024-01-02"), ("weekly", "2020-W53", "2020-12-28", "2021-01-03"), ("monthly", "2024-02", "2024-02-01", "2024-02-29")}
    assert files.digests(spark, str(tmp_path), only_usable=True).count() == 2


def test_chunk_lines_and_notes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"index": 0, "start": 0, "end": 2, "text": "t"}\n{"index": 1, "start": 1, "end": 3, "text": "t", "enriched_text": "e"}\n')
    assert sorted((r.chunk_id, r.text) for r in files.chunk_lines(spark, str(tmp_path)).collect()) == [("a-0", "t"), ("a-1", "e")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.MDWN").write_text("note")
    (tmp_path / "empty.md").write_text("")
    assert [(r.key, r.text) for r in files.notes(spark, str(tmp_path)).collect()] == [("sub/x.MDWN", "note")]


def test_replace_table(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert sinks.current_table(spark, root) is None
    for n in (3, 5):
        sinks.replace_table(spark.range(n).toDF("i"), root)
        assert sinks.current_table(spark, root).count() == n


def test_settle(spark):
    manifest = spark.createDataFrame([("a", "s1", 1, "f1", "uploaded", None), ("b", "s1", 1, "f2", "failed", "x"), ("c", "s1", 1, "f3", "ready", None)], "path string, sha256 string, size_bytes long, file_id string, phase string, error string")
    ran = [("a", "s2", 2, "f1", "uploaded", "boom", False), ("b", "s2", 2, "f2", "attached", None, True), ("d", "s9", 9, None, "new", "empty", False)]
    outcomes = spark.createDataFrame(ran, "path string, sha256 string, size_bytes long, file_id string, phase string, error string, mutated boolean")
    got = {r.path: (r.sha256, r.phase, r.error) for r in uploads.settle(manifest, outcomes).collect()}
    assert got == {"a": ("s1", "uploaded", "boom"), "b": ("s2", "attached", None), "c": ("s1", "ready", None), "d": ("s9", "new", "empty")}


URLS = [f"https://x/{i}" for i in range(1, 5)]


def links(*numbers):
    return " ".join(rf"[\[{n}\]](<https://x/{n}>)" for n in numbers)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a [1, 4] [2; 3] [1–3, 4]", f"a {links(1, 4)} {links(2, 3)} {links(1, 2, 3, 4)}"), ("[1][2]", links(1) + links(2)), ("[999] [3-1] [0]", "[999] [3-1] [0]"), ("`[1]` ``a`[1]`` [1]", f"`[1]` ``a`[1]`` {links(1)}"),
        ("[1](u) [t][2] ![1](i) \\[1] <a[1]>", "[1](u) [t][2] ![1](i) \\[1] <a[1]>"), ("```\n[1]\n```\n[1]", f"```\n[1]\n```\n{links(1)}"), ("    [1]\n[1]: u", "    [1]\n[1]: u"),
        ("x\n**Head [1]**\ny", f"x\n\n## Head {links(1)}\n\ny"), ("x\n- a\n- b", "x\n\n- a\n- b"), ("", ""), (None, ""),
    ],
)
def test_citations(text, want):
    assert citations.link_answer(text, URLS) == want


def test_queries_without_sql(spark):
    assert all("`[1]`" in r.markdown and "[2]" in r.markdown and "(<http" in r.markdown for r in catalogue.answer_links(spark, SF).collect())
    rows = catalogue.embed_messages(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/conversations.parquet").count() and rows.select("chunk_id").distinct().count() == rows.count()


def test_models():
    assert models.HashEmbedder(8)(["a", "b"]) == models.HashEmbedder(8)(["a", "b"])
    for bad in ([[1.0]], [[0.0, 0.0]], [[float("nan"), 1.0]]):
        with pytest.raises(ValueError):
            models.checked_vectors(bad, 1, 2)
    tries = iter(["short", "y" * 60])
    assert models.complete("p", lambda _: next(tries)) == "y" * 60
    with pytest.raises(RuntimeError):
        models.complete("p", lambda _: "short")
    assert models.joined_prompt(("A", "{x}"), ("B", ""), ("C", None)) == "A\n{x}"


def test_search_server():
    server = search_http.make_server(lambda q: q.upper(), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(body: bytes) -> tuple[int, dict]:
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/search", body)
        try:
            with urllib.request.urlopen(request, timeout=10) as reply:
                return reply.status, json.loads(reply.read())
        except urllib.error.HTTPError as error:
            return error.code, json.loads(error.read())

    assert ask(b'{"query": "gr\xc3\xbcn"}') == (200, {"answer": "GRÜN"})
    assert ask(b"nonsense")[0] == ask(b'{"q": 1}')[0] == ask(b'{"query": " "}')[0] == 400
    server.shutdown()
    server.server_close()
