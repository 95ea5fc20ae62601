"""Searches with filters, link facts, names, runs, publishing and resumption; nulls, ties, repeats, empty tables and hot folders."""

import json
import random
import re
from collections import Counter
from datetime import date
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from loomspan import cli, scratch
from loomspan.adapters import conversion, fetching, models
from loomspan.functions import calendar as cal
from loomspan.functions import markup
from loomspan.functions import text as tx
from loomspan.operators import chunking, context, index_page, manifests, metrics, prompts, retrieval, uploads
from loomspan.sources import files, sinks
from loomspan.streaming import watch

SF = "/root/testdata/sf0.001"


def values(spark, rows, column, schema="x string"):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_link_facts(spark):
    links = ["https://osf.io/a", "http://x.org/THE.PDF", "http://x.org/a.pdf?x", "https://www.cell.com/", None, "http://x.org/plain"]
    assert values(spark, links, tx.is_scholarly(F.col("x"))) == [True, True, False, True, None, False]
    links = ["http://x.org/a.webm", "http://x.org/a.7z?q", "http://x.org/a?b=.png", "no link", "http://x.org/a.TAR"]
    assert values(spark, links, tx.is_binary(F.col("x"))) == [True, True, False, False, True]
    assert len(tx.SCHOLARLY_HINTS) == 41 and len(tx.BINARY_ENDINGS) == 27
    cites = ["http://x.org/a", "HTTPS://x", "ftp://x", "http://", "http://x/<b>", "http://x/\n", None]
    assert values(spark, cites, tx.is_citation(F.col("x"))) == [True, True, False, False, False, False, False]
    paths = ["a/b.pdf", "B.PDF", "/a.pdf", "../a.pdf", "a/../b.pdf", "a/.b.pdf", "a//b.pdf", "a.txt", "", None, "a/b.pdf/", "x..y.pdf"]
    assert values(spark, paths, tx.is_safe_path(F.col("x"))) == [True, True, *[False] * 9, True]
    names = ["a", "A-1_b.md", ".a", "-a", "a b", "a\n", "", None]
    assert values(spark, names, tx.is_output_name(F.col("x"))) == [True, True, *[False] * 6]
    assert values(spark, ["a%20b+c", "%zz", None], tx.percent_decoded(F.col("x"))) == ["a b+c", "%zz", None]
    assert values(spark, ["a[b]\\c\r\nd\n\ne", None], tx.markdown_label(F.col("x"))) == ["a\\[b\\]\\\\c  d  e", None]


def test_failure_kinds(spark):
    contents = [None, b"", b"text", b"\x00" * 1100 + b"%PDF-", b"%PDF-1.4 /Encrypt", b"%PDF-1.4 /Type /Pages", b"%PDF-1.4 /Type/Page "]
    got = values(spark, [(None if c is None else bytearray(c),) for c in contents], tx.failure_kind(F.col("x")), "x binary")
    assert got == ["source_unavailable", "empty_file", "not_pdf", "not_pdf", "password_required", "no_readable_pages", "readable_pdf_extraction_failed"]
    text, repaired = tx.repaired_utf8(F.col("x"))
    assert values(spark, [(bytearray(b"a\xffb"),), (bytearray("é".encode()),), (None,)], text, "x binary") == ["a�b", "é", None]
    assert values(spark, [(bytearray(b"a\xffb"),), (bytearray(b"a"),)], repaired, "x binary") == [True, False]


def test_page_text(spark):
    pages = ["<p>a&nbsp;b &amp;lt; &eacute;</p>\n\n\n\n<SCRIPT x>1<2</SCRIPT><div> x   y </div>", "", None, "<style>a</style>&#x41;&#66;"]
    assert values(spark, pages, tx.html_text(F.col("x"))) == ["a b &lt; é\n\nx\ny", "", None, "AB"]
    pages = ["<title> A &amp; <i>B</i>\n</title>", "<meta content='x' name=\"dc.title\"><meta property='og:title' content=\"it's &lt;\">", "<p>", None, "<title></title><meta name='citation_title' content=' '>"]
    assert values(spark, pages, tx.html_title(F.col("x"))) == ["A & B", "it's <", "", "", ""]
    pages = ["<META NAME='Description' CONTENT=' d '>", "<meta name=citation_abstract content='z'>", "<meta property='citation_abstract' content='z'><meta property='og:description' content='o'>"]
    assert values(spark, pages, tx.html_description(F.col("x"))) == ["d", None, "o"]
    assert values(spark, [("long text", "d"), ("has d in it", "d"), ("t", None)], tx.described(F.col("x"), F.col("y")), "x string, y string") == ["Description: d\n\nlong text", "has d in it", "t"]


class Tree(HTMLParser):
    """A plain tree of a well-formed page, to compare the reader with."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = ("", {}, [], None)

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs), [], self.at)
        self.at[2].append(node)
        self.at = node if tag != "br" else self.at

    def handle_endtag(self, tag):
        self.at = self.at[3]

    def handle_data(self, data):
        self.at[2].append(data)


def test_main_text_by_tree(spark):
    random.seed(5)

    def piece(depth):
        kind = random.choice(["text", "p", "div", "nav", "article", "main", "aside", "br", "role"] if depth else ["text", "br"])
        if kind == "text":
            return random.choice(["one", "two &amp; three", " \n ", "x\n\n\n\ny"])
        if kind == "br":
            return "<br>"
        inner = "".join(piece(depth - 1) for _ in range(random.randint(0, 4)))
        return f"<div role=main>{inner}</div>" if kind == "role" else f"<{kind}>{inner}</{kind}>"

    def nodes(node):
        for child in node[2]:
            if isinstance(child, str):
                yield child
            elif child[0] not in markup.LEFT_OUT:
                yield from nodes(child)

    def first(node, fits):
        for child in node[2]:
            if not isinstance(child, str) and child[0] not in markup.LEFT_OUT:
                if fits(child):
                    return child
                if found := first(child, fits):
                    return found
        return None

    pages = ["".join(piece(4) for _ in range(5)) for _ in range(200)]
    want = []
    for page in pages:
        tree = Tree()
        tree.feed(page)
        tree.close()
        at = first(tree.root, lambda n: n[0] == "article") or first(tree.root, lambda n: n[0] == "main") or first(tree.root, lambda n: n[1].get("role") == "main") or tree.root
        text = re.sub(r"[ \t]+", " ", " ".join(nodes(at)))
        want.append(re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n".join(x.strip() for x in text.split("\n"))).strip())
    assert values(spark, pages, markup.main_text(F.col("x"))) == want
    assert markup.read(None) == "" and markup.read("<![x") is not None and markup.read("a b c", 3) == "a …[truncated]"


def test_metadata_filter(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, 'q"t'), (None, 3, "x"), ("c", None, "y")], "k string, n int, t string")
    ask = lambda text: [r.k for r in df.where(retrieval.metadata_filter(text, {"k", "n", "t"})).collect()]
    assert ask(None) == ask(" ") == ["a", "b", None, "c"]
    assert ask('k = "a" OR k = "b" AND n > 5') == ["a"] and ask('(k = "a" OR k = "b") AND n >= 2') == ["b"]
    assert ask(r't = "q\"t"') == ["b"] and ask("n != 1") == ["b", None] and ask("n < 1.5") == ["a"]
    for bad in ("k", 'k = "a" AND', 'other = "x"', "k = a", '(k = "a"', 'k = "a") ', "1 = 1", 'k = "a"; DROP', 'k = "a" k = "b"'):
        with pytest.raises(ValueError):
            ask(bad)


def test_search_modes(spark):
    near = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "doc_id long, distance double")
    words = spark.createDataFrame([(3, 2.0), (4, 2.0), (5, 1.0)], "doc_id long, score double")
    ask = lambda mode, allowed=None: [r.doc_id for r in retrieval.search(mode, lambda: near, lambda: words, 3, allowed=allowed).collect()]
    assert (ask("semantic"), ask("keyword"), ask("hybrid")) == ([1, 2, 3], [3, 4, 5], [3, 1, 2])
    assert ask("semantic", near.where("doc_id > 1")) == [2, 3]
    with pytest.raises(ValueError):
        ask("other")
    assert retrieval.dispatch("a", {"a": lambda x: x + 1}, 1) == 2
    with pytest.raises(ValueError):
        retrieval.dispatch("b", {"a": None})


def test_keyword_search_by_postings(spark):
    rows = [(1, "The cat, the CAT!"), (2, "dog cat"), (3, ""), (4, None), (5, "it's bird's"), (6, "the " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = scratch.fresh_path(spark, "test-words")
    retrieval.keyword_index(docs, root, 4)
    for terms in (["cat"], ["the", "dog"], ["absent"], ["it", "s"], ["o'x\\"]):
        got, want = ({r.doc_id: round(r.score, 9) for r in x.collect()} for x in (retrieval.indexed_scores(spark, root, terms, 4), retrieval.keyword_scores(docs, terms)))
        assert got == want and (bool(got) == (terms not in (["absent"], ["o'x\\"])))
    assert retrieval.keyword_scores(docs.limit(0), ["a"]).count() == 0


def test_batch_search_odd_vectors(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0]), (103, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 10 = 0 OR vec_id > 99").select(F.col("vec_id").alias("query_id"), "embedding")
    want = sorted(map(tuple, retrieval.batch_top_k(vectors, queries, 4).select("query_id", "vec_id", "rank").collect()))
    assert len(want) == 24 and want == sorted(map(tuple, retrieval.batch_top_k(vectors, queries, 4, block=2).select("query_id", "vec_id", "rank").collect()))
    assert retrieval.batch_top_k(vectors, queries.limit(0), 4).count() == 0 and retrieval.batch_top_k(vectors.limit(0), queries, 4).count() == 0


def test_nulls_ties_and_repeats_in_folds(spark):
    rows = [(1, 1, "a b"), (1, 2, None), (1, 2, "c"), (None, 1, "x"), (None, None, "y"), (2, 1, None), (1, 1, "a b")]
    got = chunking.message_chunks(spark.createDataFrame(rows, "conv_id long, turn long, text string"), 3, 1).collect()
    assert {(r.conv_id, r.chunk, r.first_message, r.end_message, r.n_tokens, r.chunk_text) for r in got} == {
        (1, 0, 0, 1, 2, "a b"), (1, 1, 0, 2, 4, "a b\na b"), (1, 2, 1, 4, 3, "a b\n\nc"), (None, 0, 0, 2, 2, "y\nx"), (2, 0, 0, 1, 0, "")
    }
    assert chunking.message_chunks(spark.createDataFrame([], "conv_id string, turn long, text string"), 3, 1).count() == 0
    asks = [(1, 1, 5), (1, 2, None), (1, 3, 6), (1, 4, 5), (None, 1, 9), (None, 2, 2), (None, 2, 1)]
    got = {tuple(r) for r in metrics.admit(spark.createDataFrame(asks, "account long, seq long, amount long"), 10).collect()}
    assert got == {(1, 1, 5, True), (1, 2, None, False), (1, 3, 6, False), (1, 4, 5, True), (None, 1, 9, True), (None, 2, 1, True), (None, 2, 2, False)}


def test_transfer_states_of_repeated_and_null_rows(spark):
    expected = spark.createDataFrame([("a", 5, 1), ("a", 5, 1), ("b", None, 1), ("c", 5, 1), (None, 1, 1)], "k string, size long, mtime long")
    actual = spark.createDataFrame([("a", 5, 1), ("b", 3, 1), (None, 1, 1)], "k string, size long, mtime long")
    got = Counter(tuple(r) for r in manifests.transfer_state(expected, actual, "k").collect())
    assert got == Counter({("a", "complete", 5): 2, ("b", "outdated", 0): 1, ("c", "missing", 0): 1, (None, "missing", 0): 1})


def test_sets_and_scopes(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k long") for xs in ([1, 1, 2, None], [1, 2, None, 3]))
    assert tuple(manifests.set_relation(a, b).first()) == (1, 1, False, False)
    assert tuple(manifests.set_relation(a, a).first()) == (0, 0, True, True) and tuple(manifests.set_relation(a.limit(0), b).first()) == (0, 4, True, False)
    assert sorted(r.k or 0 for r in manifests.done_keys(a, b).collect()) == [0, 1, 2, 3]
    assert sorted(r.k for r in manifests.in_scope(a, b, "k").collect()) == [1, 1, 2]
    rows = spark.createDataFrame([(1, [1, 2, 3], ["a", "b"]), (2, [], ["x"]), (3, None, ["x"])], "k long, n array<int>, t array<string>")
    assert [tuple(r) for r in manifests.zipped(rows, ["k"], ["n", "t"]).orderBy("rank").collect()] == [(1, 0, 1, "a"), (1, 1, 2, "b")]
    flags = spark.createDataFrame([(1, None), (1, False), (2, True), (2, False), (3, None)], "k long, c boolean")
    assert {tuple(r) for r in manifests.any_changed(flags, ["k"], "c").collect()} == {(1, False), (2, True), (3, False)}
    matches = spark.createDataFrame([(1, "f1"), (2, "f1"), (3, "f2"), (4, None)], "i int, file_id string")
    docs = spark.createDataFrame([("f1", None, "n1", "u"), ("f3", "x", "n3", "u")], "file_id string, filename string, name string, url string")
    assert {(r.i, r.filename, r.url) for r in manifests.lookup(matches, docs, "file_id").collect()} == {(1, "n1", "u"), (2, "n1", "u"), (3, None, None), (4, None, None)}
    days = [date(2024, 1, 1), date(2024, 2, 1), None]
    assert values(spark, [(d,) for d in days], manifests.between(F.col("x"), date(2024, 1, 15)), "x date") == [False, True, False]
    assert values(spark, [(d,) for d in days], manifests.between(F.col("x"), None, None), "x date") == [True, True, True]


def test_days_to_fetch(spark):
    held = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 3),), (None,)], "day date")
    ask = lambda df, floor: sorted(str(r.day) for r in cal.days_to_fetch(df, F.lit(date(2024, 1, 5)), F.lit(floor)).collect())
    assert ask(held, date(2023, 1, 1)) == ["2024-01-02", "2024-01-04", "2024-01-05"] and ask(held, date(2024, 1, 4)) == ["2024-01-04", "2024-01-05"]
    assert ask(held.limit(0), date(2023, 1, 1)) == ["2024-01-05"] and ask(held, date(2024, 2, 1)) == []


def test_contexts_and_prompts(spark):
    rows = [("f", None, None, None, 0.5), (None, "d", None, None, None), (None, None, "pages", None, 0.25), (None, None, None, "n", 1.0), (None, None, None, None, None)]
    head = context.passage_header({k: F.col(k) for k in ("file", "date", "source_type", "filename")}, F.col("score"))
    got = values(spark, rows, head, "file string, date string, source_type string, filename string, score double")
    assert got == ["[From f lines ?-?]", "[Date: d, Score: ?]", "[Source: pages, File: unknown, Score: 0.2500]", "[Source: n, Score: 1.0000]", "[Score: ?]"]
    assert values(spark, [("u", None, "pdf"), ("u", "t", "html")], context.link_block(F.col("x"), F.col("y"), F.col("z"), F.lit(None), F.lit("")), "x string, y string, z string") == ["URL: u\nType: pdf", "URL: u\nTitle: t"]
    assert values(spark, [(None, "{b}"), ("", None)], prompts.sections(("A", F.col("x")), ("B", F.col("y"))), "x string, y string") == ["B\n{b}", ""]
    assert values(spark, [True, None], prompts.first_of((("a", F.col("x")),), "c"), "x boolean") == ["a", "c"]


def test_offsets_of_stopped_runs(spark):
    manifest = spark.createDataFrame([("a", "r1"), ("b", "r2"), ("c", "r1")], "paper string, revision string")
    progress = spark.createDataFrame([("a", "r1", c) for c in (0, 1, 1, 3)] + [("b", "r1", 0), ("c", "r1", 1)], "paper string, revision string, chunk long")
    assert {tuple(r) for r in manifests.next_offsets(manifest, progress, "paper").collect()} == {("a", "r1", 2), ("b", "r2", 0), ("c", "r1", 0)}


def test_estimates(spark):
    none = spark.createDataFrame([], "size long, source_size long")
    assert tuple(metrics.extrapolation(none, none.select("size")).first()) == (None, None, None, None)
    done = spark.createDataFrame([(10, 100), (20, 100)], "size long, source_size long")
    total = spark.createDataFrame([(100,), (100,), (50,), (None,)], "size long")
    assert tuple(metrics.extrapolation(done, total).first()) == (60, 38, 38, 60)
    assert tuple(metrics.inventory(spark.createDataFrame([], "path string, size long")).first()) == (0, 0, 0.0, [])
    assert values(spark, [(5, 0.0), (0, 2.0), (6, 3.0)], metrics.eta_hours(F.col("x"), F.col("y")), "x long, y double") == [None, None, 2.0]
    assert values(spark, [(5.0,), (None,)], metrics.within_budget(F.col("x"), 5), "x double") == [True, False] and values(spark, [(5.0,)], metrics.within_budget(F.col("x"), 5, True), "x double") == [False]


def test_files_below_hidden_folders(spark, tmp_path):
    root = tmp_path / ".cache" / "logs"
    (root / ".git").mkdir(parents=True)
    (root / "2024-01-02.log").write_text("12:00 <a> hi")
    (root / ".git" / "2024-01-03.log").write_text("12:00 <a> hidden")
    (root / "a b").mkdir()
    (root / "a b" / "n.md").write_text("note")
    assert [str(r.day) for r in files.day_logs(spark, str(root)).collect()] == ["2024-01-02"]
    assert [r.key for r in files.notes(spark, str(root)).collect()] == ["a b/n.md"]


def test_corpora(spark, tmp_path):
    for name, text in (("one/a.txt", "A"), ("one/empty.log", ""), ("posts/p.md", "P"), ("pages/deep/q.md", "Q")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    read = lambda shape, root: {(r.key, r.source_type, r.text) for r in files.corpus(spark, str(root), files.CORPORA[shape]).collect()}
    assert read("site", tmp_path) == {("posts/p.md", "posts", "P"), ("pages/q.md", "pages", "Q")}
    assert read("threads", tmp_path / "one") == {("a.txt", None, "A")} and read("pages", tmp_path / "pages") == {("deep/q.md", None, "Q")}
    (tmp_path / "one" / "empty.log").unlink()
    assert read("logs-or-any", tmp_path / "one") == {("a.txt", None, "A")} and read("logs", tmp_path / "one") == set()


def test_stream_reads_the_stated_path_alone(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "event_id long, event_type string, value double")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    rows.write.parquet(str(tmp_path / "events_old.parquet"))
    assert {(r.state, r.n) for r in watch.state_totals(spark, str(tmp_path / "events.parquet")).collect()} == {("a", 1), ("b", 1)}
    assert sum(r.n for r in watch.state_totals(spark, f"{SF}/events.parquet").collect()) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_progress_lines(spark, tmp_path):
    spark.createDataFrame([("ready",), ("ready",), ("failed",)], "state string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("state string").parquet(str(tmp_path / "in"))
    watch.report_progress(source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    (line,) = [json.loads(x) for f in (tmp_path / "out").glob("*/*.json") for x in f.read_text().splitlines()]
    assert line == {"states": {"failed": 1, "ready": 2}, "rows": 3}


def test_fetching(spark):
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 3)], "day date")
    held = spark.createDataFrame([(date(2024, 1, 1), "here")], "day date, raw string")

    def fetch_day(day):
        if day.day == 3:
            raise OSError("gone")
        return f"log of {day}"

    assert {(r.day.day, r.raw, r.error) for r in fetching.day_logs(spark, days, held, fetch_day).collect()} == {(1, "here", None), (2, "log of 2024-01-02", None), (3, None, "OSError: gone")}

    def fetch(url, most):
        if "down" in url:
            raise TimeoutError("slow")
        if "missing" in url:
            return 404, "text/html", b"no"
        if "paper" in url:
            return 200, "application/pdf", b"%PDF"
        return 200, "text/html", "<title>Café</title><meta name='description' content='told'><p>“text”</p>".encode("cp1252")

    links = spark.createDataFrame([(i, u) for i, u in enumerate(["http://x.org/a", "http://x.org/down", "http://x.org/missing-page", "http://x.org/paper", "http://x.org/v.mp4", "http://a.skip.org/x"])], "i int, url string")
    pages = fetching.fetch_pages(links, fetch, ["i"], skip_hosts=("skip.org",))
    got = {r.i: (r.kind, r.title, r.text, r.error) for r in fetching.describe(pages, ["i"]).collect()}
    assert got == {
        0: ("html", "Café", "Description: told\n\nCafé “text”", None), 1: ("html", "down", None, "TimeoutError: slow"),
        2: ("html", "missing page", None, "HTTP 404"), 3: ("pdf", "paper", None, None),
    }
    assert fetching.charset_of("text/html; charset=KOI8-R", b"") == "koi8-r" and fetching.charset_of("a; charset=none-such", b"x") == "utf-8" and fetching.charset_of("", b"\xe9\xe9 abcdef") == "cp1252"


def test_add_file(spark, tmp_path):
    fetching.add_file(spark, str(tmp_path), "a/b.pdf", b"junk %PDF-1.4")
    assert (tmp_path / "a" / "b.pdf").read_bytes() == b"junk %PDF-1.4"
    with pytest.raises(FileExistsError):
        fetching.add_file(spark, str(tmp_path), "a/b.pdf", b"%PDF-1.5")
    for path, content in (("../b.pdf", b"%PDF-"), ("c.pdf", b"\x00" * 1024 + b"%PDF-")):
        with pytest.raises(ValueError):
            fetching.add_file(spark, str(tmp_path), path, content)
    assert [r.path for r in fetching.remote_inventory(spark, lambda: iter([("a b.pdf", 1, 2), (".x.pdf", 1, 2)])).collect()] == ["a%20b.pdf"]


def test_publishing(spark, tmp_path):
    outputs = lambda text: spark.createDataFrame([("a", text), ("b", "same")], "name string, content string")
    sent = []
    run = lambda text: sorted(r.name for r in sinks.publish(spark, str(tmp_path), outputs(text), lambda n, c: f"<p>{c}", lambda *x: sent.append(x), "host").collect())
    assert run("one") == ["a", "b"] and run("one") == [] and run("two") == ["a"]
    assert (tmp_path / "a.md").read_text() == "two" and (tmp_path / "a.html").read_text() == "<p>two" and len(sent) == 3
    result = {"question": "q", "passages": [{"content": "c", "metadata": {"pdf_path": "p.pdf"}}], "answer": "half", "complete": False}
    assert sorted(p.rsplit("/", 1)[1] for p in sinks.save_result(spark, str(tmp_path), "r", result)) == ["r-context.partial.md", "r.partial.json", "r.partial.md"]
    with pytest.raises(ValueError):
        sinks.save_result(spark, str(tmp_path), "r", {})
    keys = spark.createDataFrame([("k",)], "key string")
    for _ in range(2):
        sinks.append_keys(keys, str(tmp_path / "done"))
    assert sinks.done(spark, str(tmp_path / "done"), "key string").count() == 1 and sinks.done(spark, str(tmp_path / "none"), "key string").count() == 0


def test_budgeted_embedding(spark):
    rows = spark.createDataFrame([("a", 1, "x" * 60), ("a", 2, "y" * 60), ("a", 3, "z"), ("b", 1, "w" * 40_000), ("b", 2, None)], "account string, seq long, text string")
    rows = rows.withColumn("account", F.when(F.col("account") == "a", 1).otherwise(2).cast("long")).withColumn("key", models.cache_key(F.col("text"), "m"))
    root = scratch.fresh_path(spark, "vectors")
    first = {(r.account, r.seq): r.state for r in models.embed_budgeted(rows, root, models.HashEmbedder(8), 130).collect()}
    assert first == {(1, 1): "embedded", (1, 2): "refused", (1, 3): "embedded", (2, 1): "too long", (2, 2): "embedded"}
    again = {(r.account, r.seq): r.state for r in models.embed_budgeted(rows, root, models.HashEmbedder(8), 130).collect()}
    assert again == {(1, 1): "cached", (1, 2): "embedded", (1, 3): "cached", (2, 1): "too long", (2, 2): "cached"}
    assert sinks.current_table(spark, root).count() == 4


def test_answers():
    assert models.answer("q", "c", lambda asked, most: (f"{asked}|{most}", "stop"), brief=True, extra="e") == "Question: q\n\nAdditional instructions:\ne\n\nPaper excerpts:\nc|1800"
    with pytest.raises(models.IncompleteAnswer) as cut:
        models.answer("q", "c", lambda *_: ("half", "length"))
    assert cut.value.text == "half"
    with pytest.raises(ValueError):
        models.answer("q", "c", lambda *_: (" ", "stop"))
    assert models.searched_answer("q", lambda w: f"found {w}", lambda p: "words" if "search query" in p else p).startswith("Search query: words\n\nContext\nfound words")
    calls = []

    def flaky(texts):
        calls.append(texts)
        if len(calls) == 1:
            raise ValueError("No embedding data received")
        return [[1.0]]

    assert models.with_retry(flaky)(["x"]) == [[1.0]] and len(calls) == 2


def test_commands(spark, tmp_path, capsys):
    papers = spark.createDataFrame([("p", "some text of a paper"), ("q", "")], "paper string, text string").withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    papers.write.parquet(str(tmp_path / "papers"))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "2024-01-02.log").write_text("12:00 <a> hi")
    for kind, label in (("daily", "2024-01-02"), ("daily", "2024-01-03"), ("weekly", "2023-W52")):
        (tmp_path / "digests" / kind).mkdir(parents=True, exist_ok=True)
        (tmp_path / "digests" / kind / f"{label}.md").write_text(f"# Day {label}\n" + "text " * 20)

    def run(*words):
        parsed = cli._parser().parse_args([str(w) for w in words])
        if parsed.command == "search":
            cli._print(cli.found(spark, parsed.tables, parsed.words, parsed.top_k, parsed.mode, parsed.filter, parsed.vector))
        else:
            cli.reports(spark, parsed)
        return capsys.readouterr().out.strip().splitlines()

    assert len(run("search", SF, "that", "with", "--top-k", 3, "--filter", 'lang = "en"')) == 3 and len(run("search", SF, "that", "--mode", "hybrid", "--top-k", 2)) == 2
    assert run("context", SF, "that", "--top-k", 2)[0].startswith("[Source: ")
    run("index", tmp_path / "papers", tmp_path / "index")
    assert [json.loads(x) for x in run("status", tmp_path / "index")] == [{"state": "failed", "papers": 1, "passages": 0}, {"state": "ready", "papers": 1, "passages": 1}]
    assert json.loads(run("failures", tmp_path / "index")[0]) == {"paper": "q", "error": "no text to embed"} and run("audit", tmp_path / "index") == []
    run("keyword-index", f"{SF}/documents.parquet", tmp_path / "words")
    assert len(run("keyword-search", tmp_path / "words", "that", "--top-k", 2)) == 2
    assert json.loads(run("inventory", tmp_path / "logs", "--pattern", "*.log")[0])["files"] == 1 and json.loads(run("cost", tmp_path / "digests")[0])["files"] == 3
    assert run("missing", tmp_path / "logs", "--today", "2024-01-04") == ['{"day": "2024-01-03"}', '{"day": "2024-01-04"}']
    run("corpus", "logs", tmp_path / "logs", tmp_path / "corpus")
    assert spark.read.parquet(str(tmp_path / "corpus")).count() == 1
    run("summarize", tmp_path / "digests", tmp_path / "weekly")
    assert [json.loads(x)["label"] for f in (tmp_path / "weekly").glob("*.json") for x in f.read_text().splitlines()] == ["2024-W01"]
    run("index-page", tmp_path / "digests", tmp_path / "index.html")
    assert "Day 2024-01-02" in (tmp_path / "index.html").read_text()


def test_conversion(spark):
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in (("a", b"text a"), ("b", b"crash"), ("c", b"bad"), ("d", b" "), ("e", b"done"))], "path string, content binary")

    def plain(content):
        if content == b"crash":
            raise conversion.ConverterCrash("signal 11")
        if content == b"bad":
            raise ValueError("no pages")
        return content.decode()

    done = files.where("path = 'e'").select("path", F.sha2("content", 256).alias("sha256"))
    got = {r.path: (r.status, r.error, r.text) for r in conversion.convert(files, done, plain, lambda c: "by the old way").collect()}
    assert got == {"a": ("ready", None, "text a"), "b": ("ready", None, "by the old way"), "c": ("failed", "no pages", None), "d": ("failed", "no text", None)}
    assert {r.path: r.error for r in conversion.convert(files, done, plain).collect()}["b"] == "signal 11"
    manifest = spark.createDataFrame([("a", "h1", "old", 1), ("b", "h2", "old", 2)], "path string, text_sha256 string, text string, n int")
    repairs = spark.createDataFrame([("a", "h1", "new"), ("b", "h0", "new")], "path string, read_sha256 string, text string")
    assert {(r.path, r.text, r.n) for r in conversion.repaired(manifest, repairs).collect()} == {("a", "new", 1), ("b", "old", 2)}

    def fails():
        raise OSError("no network")

    assert conversion.update_checkout(lambda: None, fails, False) == "cloned" and conversion.update_checkout(fails, fails, True) == "stale" and conversion.update_checkout(fails, lambda: None, True) == "pulled"


def test_upload_gates(spark):
    fine = spark.createDataFrame([("a", None)], "path string, reason string")
    bad = spark.createDataFrame([("a", "too large")], "path string, reason string")
    files = spark.createDataFrame([("a", 5)], "path string, size long")
    ask = lambda p=fine, local=files, cost=1.0, budget=2.0, ok=True, dry=False, overlap=2, keys=True: uploads.gate(p, files, local, cost, budget, ok, dry, 10, overlap, keys)
    assert ask() is None and ask(overlap=10) == "arguments" and ask(dry=True, ok=False) == "dry run" and ask(ok=False) == "approval"
    assert ask(bad) == "converted" and ask(local=files.limit(0)) == "inventory" and ask(cost=2.0) == "budget" and ask(budget=None) is None and ask(keys=False) == "keys"
    rows = [("send", None), ("send", "x"), ("unchanged", None), ("reconcile", None)]
    assert tuple(uploads.run_summary(spark.createDataFrame(rows, "action string, error string")).first()) == (1, 1, 1, 1, False)


def test_hooks(spark):
    chunks = spark.createDataFrame([("a",), (None,)], "text string")
    assert [r.enriched_text for r in chunking.enriched(chunks).collect()] == ["a", None] and [r.enriched_text for r in chunking.enriched(chunks, F.upper).collect()] == ["A", None]
    rows = spark.createDataFrame([(1, 1, "abcd"), (1, 2, "ef")], "conv_id long, turn long, text string")
    assert [r.n_tokens for r in chunking.message_chunks(rows, 5, 1, F.length).orderBy("chunk").collect()] == [4, 6]
    found = index_page.items(spark.createDataFrame([("daily", "2024-01-02", "# A </b>", 7), ("daily", "2024-01-01", "", 8)], "kind string, label string, text string, mtime long"))
    told = index_page.payload(found, spark.createDataFrame([], "kind string, label string")).first().payload
    assert [x["mtime"] for x in json.loads(told.replace("<\\/", "</"))["items"]] == [8, 7] and "</" not in told
