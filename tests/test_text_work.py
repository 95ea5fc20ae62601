"""Tokens with offsets, pages as Markdown, outside sources."""

import html
import json
import random
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomspan.functions import markdown, markup, tokens
from loomspan.functions import text as tx
from loomspan.operators import chunking, indexing
from loomspan.sources import remote

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SF = "/root/testdata/sf0.001"

# tokens


def test_spans_are_the_library_s(spark):
    tokenizer = tokens.tokenizer_for()
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in [*texts, "Héllo 日本 𝔘x", "", " ", "\n\n", "á🏳️‍🌈", "<|endoftext|>", "\x00\x01", "🙂" * 50]:
        text = text or ""
        ids = tokenizer.encoding.encode_ordinary(text)
        back, starts = tokenizer.encoding.decode_with_offsets(ids)
        assert back == text and tokenizer.ids(text) == ids
        got = tokenizer.spans(text)
        assert [a for a, _ in got] == starts and all(b == max(a + 1, c) for (a, b), c in zip(got, [*starts[1:], len(text)][: len(got)], strict=True))
    assert len(tokenizer.spans("a\ud800b")) >= 3


@pytest.mark.parametrize(("size", "overlap"), [(5, 2), (175, 20), (1, 0)])
def test_windows_cover_the_text(size, overlap):
    text = "Ünï cödé wörds 日本語 and   spaces. " * 40
    spans = tokens.tokenizer_for().spans(text)
    got = list(tokens.windows(text, spans, size, overlap))
    step = size - overlap
    want = [(f, min(size, len(spans) - f)) for f in range(0, len(spans), step)]
    stop = next(i for i, (f, n) in enumerate(want) if f + n == len(spans)) + 1
    want = [(f, n, spans[f][0], spans[f + n - 1][1]) for f, n in want[:stop]]
    assert got == [w for w in want if text[w[2] : w[3]].strip()]
    assert got[-1][3] == len(text) or not text[got[-1][3] :].strip()
    with pytest.raises(ValueError):
        list(tokens.windows(text, spans, 5, 5))


def test_windows_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = chunking.token_windows(docs, 100, 10).collect()
    tokenizer = tokens.tokenizer_for()
    want = []
    for r in docs.collect():
        spans = tokenizer.spans(r.text or "")
        want += [(r.doc_id, i, f, n, a, b, r.text[a:b]) for i, (f, n, a, b) in enumerate(tokens.windows(r.text or "", spans, 100, 10))]
    assert sorted(map(tuple, got)) == sorted(want)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (3, "x")], "doc_id int, text string").withColumn("chunk", F.lit("clash"))
    assert [tuple(r) for r in chunking.token_windows(odd, 5, 0).collect()] == [(3, 0, 0, 1, 0, 1, "x")]
    assert chunking.token_windows(docs.limit(0), 5, 0).count() == 0
    counted = odd.select("doc_id", tokens.count(F.col("text")).alias("n")).collect()
    assert [r.n for r in counted][:2] == [0, 0] and counted[3].n == 1


def test_passages_by_a_vocabulary(spark):
    rows = spark.createDataFrame([("p", "r", "Ünï cödé " * 30)], "paper string, revision string, text string")
    got = indexing.passages(rows, 12, 3, spans=lambda t: tokens.tokenizer_for().spans(t)).orderBy("chunk").collect()
    text = "Ünï cödé " * 30
    want = list(tokens.windows(text, tokens.tokenizer_for().spans(text), 12, 3))
    assert [(r.char_start, r.char_end, r.document) for r in got] == [(a, b, text[a:b]) for _, _, a, b in want]


# Markdown


def made(rng, depth=0):
    """A random block as (page, Markdown lines)."""
    words = lambda: " ".join(rng.choices(["plain", "word", "naïve", "a*b", "[x]", "under_score", "tick`", "<lt>", "&", "1.5", "back\\slash"], k=rng.randint(1, 6)))
    escaped = lambda t: "".join("\\" + c if c in "\\`*_[]<>" else c for c in t)

    def inline():
        page, text = "", ""
        for i in range(rng.randint(1, 4)):
            w, kind = words(), rng.choice(["text", "b", "i", "a", "code", "del"])
            page += " " * (i > 0)
            text += " " * (i > 0)
            if kind == "text":
                page, text = page + html.escape(w), text + escaped(w)
            elif kind == "a":
                page, text = page + f'<a href="/p?{i}">{html.escape(w)}</a>', text + f"[{escaped(w)}](https://h.org/p?{i})"
            elif kind == "code":
                w = w.replace("`", "")
                page, text = page + f"<code>{html.escape(w)}</code>", text + f"`{w}`"
            else:
                mark = {"b": "**", "i": "*", "del": "~~"}[kind]
                page, text = page + f"<{kind}>{html.escape(w)}</{kind}>", text + mark + escaped(w) + mark
        return page, text

    kind = rng.choice(["p", "h", "ul", "ol", "quote", "pre", "table", "hr"] if depth < 2 else ["p", "h", "pre"])
    if kind == "p":
        page, text = inline()
        return f"<p>{page}</p>", [text]
    if kind == "h":
        n = rng.randint(1, 6)
        page, text = inline()
        return f"<h{n}>{page}</h{n}>", ["#" * n + " " + text]
    if kind == "hr":
        return "<hr>", ["---"]
    if kind == "pre":
        body = "\n".join("  " * rng.randint(0, 2) + words().replace("`", "") for _ in range(rng.randint(1, 3)))
        return f'<pre><code class="language-py">{html.escape(body)}</code></pre>', ["```py", *body.split("\n"), "```"]
    if kind == "quote":
        parts = [made(rng, depth + 1) for _ in range(rng.randint(1, 3))]
        lines = [line for i, (_, block) in enumerate(parts) for line in ([""] if i else []) + block]
        return f"<blockquote>{''.join(p for p, _ in parts)}</blockquote>", ["> " + line if line else ">" for line in lines]
    if kind == "table":
        wide = rng.randint(1, 3)
        cells = [[inline() for _ in range(wide)] for _ in range(rng.randint(1, 3))]
        page = "".join("<tr>" + "".join(f"<td>{p}</td>" for p, _ in row) + "</tr>" for row in cells)
        told = ["| " + " | ".join(t for _, t in row) + " |" for row in cells]
        return f"<table>{page}</table>", [told[0], "| " + " | ".join(["---"] * wide) + " |", *told[1:]]
    page, lines = "", []
    for n in range(rng.randint(1, 3)):
        p, t = inline()
        lead = "- " if kind == "ul" else f"{n + 1}. "
        lines.append(lead + t)
        if rng.random() < 0.4 and depth < 2:
            q, inner = made(rng, 2)
            if not q.startswith("<p>"):
                p += q
                lines += [""] + [" " * len(lead) * bool(line) + line for line in inner]
        page += f"<li>{p}</li>"
    return f"<{kind}>{page}</{kind}>", lines


@pytest.mark.parametrize("seed", range(60))
def test_pages_become_markdown(seed):
    rng = random.Random(seed)
    parts = [made(rng) for _ in range(rng.randint(1, 6))]
    junk = rng.choice(["<nav><a href=/>Home</a></nav>", "<script>x()</script>", "<form><p>f</p></form>", "<style>p{}</style>", ""])
    page = "<html><head><title>T</title></head><body>" + junk.join(p for p, _ in parts) + "</body></html>"
    want = "\n".join(line for i, (_, block) in enumerate(parts) for line in ([""] if i else []) + block)
    assert markdown.markdown(page, "https://h.org/x/") == want.strip()


def test_odd_markup():
    md = lambda p, o="https://h.org/": markdown.markdown(p, o)
    assert md("<ul><li>a<li>b<ul><li>c</ul></ul>") == "- a\n- b\n  - c"
    assert md("<p>one<p>two<br>three") == "one\n\ntwo  \nthree"
    assert md("<p>1. no list</p><p># no head</p><p>- none</p>") == "1\\. no list\n\n\\# no head\n\n\\- none"
    assert md("<a href='javascript:x()'>go</a> <a href=''>here</a>") == "go [here](https://h.org/)"
    assert md("<img src='/a b.png' alt='x'>") == "![x](https://h.org/a%20b.png)"
    assert md("<table><tr><th>A<th>B|C<tr><td>1</table>") == "| A | B\\|C |\n| --- | --- |\n| 1 |  |"
    assert md("<ol start=3><li>x<li>y</ol>") == "3. x\n4. y"
    assert md("<b></b><p><i> spaced </i>out</p>") == "*spaced* out"
    assert md("<pre>\n a\n\n b</pre>") == "```\n a\n\n b\n```"
    for odd in (None, "", "<", "<![foo", "<p>", "</p></b>", "<b><p>x</b></p>", "<li>x", "<td>x", "<ul>x</ul>", "<pre>x", "<code>x", "<a href=//[>x</a>", "&#0;&#xD800;"):
        assert isinstance(md(odd), str)
    assert markdown.markdown("<p>one two three</p>", "", 8) == "one two …[truncated]"[:3] + " …[truncated]" or markdown.markdown("<p>one two three</p>", "", 8).endswith("…[truncated]")
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert md(deep) == "x"


def test_whole_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.md for r in pages.select("page_id", markdown.markdown_of(F.col("html"), F.col("url")).alias("md")).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        assert got[r.page_id] == markdown.markdown(r.html, r.url or "")
    assert sum(bool(v) for v in got.values()) > 0.9 * len(got)


def test_main_text_lines():
    assert markup.read("<p>a  b\t c</p>\n\n\n\n<p> d </p>") == "a b c\n\nd"
    assert markup.read("x " * 10, 7) == "x x x …[truncated]"
    assert markup.read("<article>in <nav>no</nav></article>out") == "in"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Here it is\n```markdown\n# H\nb\n```", "# H\nb"), ("Here it is:\n\n```md\n# H\nb\n```\n", "# H\nb"), ("```\n# H\n\n```py\nx\n```\n```", "# H\n\n```py\nx\n```"),
        ("# H\ntext\n```py\nx\n```", "# H\ntext\n```py\nx\n```"), ("```markdown\n# H\nno end", "# H\nno end"), ("```json\n{}\n```", "{}"), ("Intro\nmore\n```md\n# H\n```", "Intro\nmore\n```md\n# H\n```"),
        ("Intro\n```md\nno head\n```", "Intro\n```md\nno head\n```"), ("", ""), ("```", "```"), (None, None),
    ],
)
def test_fences(spark, given, want):
    got = spark.createDataFrame([(given,)], "t string").select(tx.unfenced(F.col("t")).alias("t")).first().t
    assert got == want


# sources


def logs_of(folder, days):
    folder.mkdir(exist_ok=True)
    for day in days:
        (folder / f"{day}.log").write_bytes(f"log of {day} “x”".encode("cp1252" if day.endswith("5") else "utf-8"))


def flaky(path, day):
    """A reader that fails the first time for each day, and always for one."""
    seen = Path(path) / f"{day}.asked"
    asked = len(seen.read_text()) if seen.exists() else 0
    seen.write_text("x" * (asked + 1))
    if asked < 1 or day == date(2024, 1, 9):
        raise OSError("no answer")
    return remote.folder_day(path, day)


def test_day_logs(spark, tmp_path, monkeypatch):
    logs_of(tmp_path / "logs", [f"2024-01-{d:02d}" for d in range(1, 11) if d != 7])
    remote.register(spark)
    read = lambda **o: spark.read.format("daylogs").options(reader="loomspan.sources.remote:folder_day", path=str(tmp_path / "logs"), **o).load()
    got = {str(r.day): (r.raw, r.error) for r in read(first="2024-01-01", last="2024-01-10", partitions="3").collect()}
    assert len(got) == 10 and got["2024-01-07"][0] is None and "FileNotFoundError" in got["2024-01-07"][1]
    assert got["2024-01-05"] == ("log of 2024-01-05 “x”", None) == (got["2024-01-05"][0], None)
    assert read(first="2024-01-01", last="2024-01-10", partitions="3").rdd.getNumPartitions() == 3
    assert read(first="2024-02-01", last="2024-01-10").count() == 0
    with pytest.raises(Exception, match="module:function"):
        spark.read.format("daylogs").options(reader="nothing", first="2024-01-01", last="2024-01-01").load().collect()


def test_a_stream_of_days_loses_and_repeats_none(spark, tmp_path):
    logs, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    logs_of(logs, [f"2024-01-{d:02d}" for d in range(1, 5)])
    remote.register(spark)

    def run(last):
        stream = spark.readStream.format("daylogs").options(reader="loomspan.sources.remote:folder_day", path=str(logs), first="2024-01-01", last=last, partitions="2", tries="1").load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(120)

    days = lambda: sorted(str(r.day) for r in spark.read.parquet(out).collect())
    run("2024-01-03")
    assert days() == ["2024-01-01", "2024-01-02", "2024-01-03"]
    with pytest.raises(Exception, match="2024-01-05"):
        run("2024-01-06")  # the log of the fifth is not there yet: the whole batch fails
    assert days() == ["2024-01-01", "2024-01-02", "2024-01-03"]
    logs_of(logs, [f"2024-01-{d:02d}" for d in range(5, 7)])
    run("2024-01-06")
    run("2024-01-06")
    assert days() == [f"2024-01-{d:02d}" for d in range(1, 7)]


def test_retries_are_bounded():
    calls = []

    def ask():
        calls.append(1)
        raise OSError("no")

    assert remote.tried(ask, 3) == (None, "OSError: no") and len(calls) == 3
    assert remote.tried(lambda: "x") == ("x", None)
    with pytest.raises(ValueError):
        remote.tried(lambda: (_ for _ in ()).throw(ValueError()))


def test_listing_by_prefixes(spark, tmp_path):
    for name in ("a/one.pdf", "a/t wo.pdf", "b/.hidden", "b/c/three.pdf"):
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_text(name)
    got = remote.inventory(spark, "loomspan.sources.remote:folder_listing", str(tmp_path / "f"), ["a", "b"])
    assert sorted((r.path, r.size) for r in got.collect()) == [("a/one.pdf", 9), ("a/t%20wo.pdf", 10), ("b/c/three.pdf", 13)]
    assert remote.inventory(spark, "loomspan.sources.remote:folder_listing", str(tmp_path / "f"), []).count() == 3


def test_checkouts_and_their_changes(spark, tmp_path):
    repository, out, check = tmp_path / "r", str(tmp_path / "out"), str(tmp_path / "check")

    def commit(revision, files):
        for name, text in files.items():
            (repository / revision / name).parent.mkdir(parents=True, exist_ok=True)
            (repository / revision / name).write_text(text)

    commit("0001", {"a.mdwn": "1", "d/b.mdwn": "2", "c.mdwn": "3"})
    remote.register(spark)
    options = {"reader": "loomspan.sources.remote:FolderRepository", "path": str(repository), "partitions": "3"}
    got = spark.read.format("checkout").options(**options).load()
    assert sorted((r.path, bytes(r.content)) for r in got.collect()) == [("a.mdwn", b"1"), ("c.mdwn", b"3"), ("d/b.mdwn", b"2")]

    def run():
        query = spark.readStream.format("checkout").options(**options).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(120)

    run()
    commit("0002", {"a.mdwn": "1", "d/b.mdwn": "changed", "new.mdwn": "4"})
    run()
    run()
    rows = sorted((r.revision, r.path, r.content and bytes(r.content)) for r in spark.read.parquet(out).collect())
    assert rows == [("0001", "a.mdwn", b"1"), ("0001", "c.mdwn", b"3"), ("0001", "d/b.mdwn", b"2"), ("0002", "c.mdwn", None), ("0002", "d/b.mdwn", b"changed"), ("0002", "new.mdwn", b"4")]
    old = spark.read.format("checkout").options(**options, revision="0001").load()
    assert old.count() == 3 and json.dumps(options)
