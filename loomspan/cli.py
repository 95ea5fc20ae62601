"""Command line: queries, logs, searches, indexes and their state, inventories, digests."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from loomspan.session import build_session


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loomspan")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="list the registered queries")
    run = commands.add_parser("run", help="run a query and write its result as Parquet")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("output")
    logs = commands.add_parser("preprocess", help="parse day logs and write message chunks as JSON lines")
    logs.add_argument("logs")
    logs.add_argument("output")
    logs.add_argument("--max-tokens", type=int, default=800)
    logs.add_argument("--overlap", type=int, default=100)
    search = commands.add_parser("search", help="print the best documents for words as JSON lines")
    search.add_argument("tables")
    search.add_argument("words", nargs="+")
    search.add_argument("--top-k", type=int, default=8)
    search.add_argument("--filter", help='such as: lang = "en" AND n_chars >= 200')
    search.add_argument("--mode", choices=("keyword", "semantic", "hybrid"), default="keyword")
    search.add_argument("--vector", type=int, default=0, help="the vector that stands for the question where the mode asks for one")
    context = commands.add_parser("context", help="print the context of a search: headed passages, one after the other")
    context.add_argument("tables")
    context.add_argument("words", nargs="+")
    context.add_argument("--top-k", type=int, default=4)
    build = commands.add_parser("index", help="index new and changed papers of a table (paper, text, sha256)")
    build.add_argument("papers")
    build.add_argument("root")
    for name, told in (("status", "print counts of papers by state"), ("failures", "print failed papers with their errors"), ("audit", "compare the stored passages with the manifest")):
        commands.add_parser(name, help=told).add_argument("root")
    words = commands.add_parser("keyword-index", help="write postings of a table of documents")
    words.add_argument("documents")
    words.add_argument("root")
    find = commands.add_parser("keyword-search", help="search written postings")
    find.add_argument("root")
    find.add_argument("words", nargs="+")
    find.add_argument("--top-k", type=int, default=8)
    listing = commands.add_parser("inventory", help="print number and size of files")
    listing.add_argument("root")
    listing.add_argument("--pattern", default="*")
    cost = commands.add_parser("cost", help="print what storing files costs")
    cost.add_argument("root")
    cost.add_argument("--pattern", default="*.md")
    cost.add_argument("--days", type=int, default=30)
    cost.add_argument("--searches", type=int, default=0)
    gaps = commands.add_parser("missing", help="print the days without a log")
    gaps.add_argument("logs")
    gaps.add_argument("--today")
    gaps.add_argument("--since", default="2021-01-01")
    corpus = commands.add_parser("corpus", help="read a corpus of a known shape and write it as Parquet")
    corpus.add_argument("shape")
    corpus.add_argument("root")
    corpus.add_argument("output")
    digest = commands.add_parser("summarize", help="build weekly digests from daily ones and write them as JSON lines")
    digest.add_argument("digests")
    digest.add_argument("output")
    page = commands.add_parser("index-page", help="write the page that lists all digests")
    page.add_argument("digests")
    page.add_argument("output")
    resume = commands.add_parser("resume", help="index the papers of a table (paper, text, sha256) in rounds, going on where the last run stopped")
    resume.add_argument("papers")
    resume.add_argument("root")
    resume.add_argument("--recipe", default="175/20")
    resume.add_argument("--batch", type=int, default=1000)
    resume.add_argument("--rounds", type=int)
    commands.add_parser("progress", help="print how far each paper of a resumed index is").add_argument("root")
    checked = commands.add_parser("audit-passages", help="compare every stored passage of a resumed index with the text that it was cut from")
    checked.add_argument("papers")
    checked.add_argument("root")
    checked.add_argument("--recipe", default="175/20")
    vectors = commands.add_parser("vector-index", help="write an approximate index of a table of vectors (vec_id, embedding)")
    vectors.add_argument("vectors")
    vectors.add_argument("root")
    nearest = commands.add_parser("vector-search", help="print the nearest vectors of one that a table holds")
    nearest.add_argument("root")
    nearest.add_argument("vectors")
    nearest.add_argument("vec_id", type=int)
    nearest.add_argument("--top-k", type=int, default=8)
    nearest.add_argument("--probes", type=int)
    pages = commands.add_parser("markdown", help="write pages (page_id, url, html) as Markdown")
    pages.add_argument("pages")
    pages.add_argument("output")
    pages.add_argument("--most", type=int)
    counted = commands.add_parser("tokens", help="print how many tokens and windows the texts of a table have, and what embedding them costs")
    counted.add_argument("texts")
    counted.add_argument("--size", type=int, default=175)
    counted.add_argument("--overlap", type=int, default=20)
    counted.add_argument("--price", type=float, default=0.01, help="money for a million tokens")
    fetch = commands.add_parser("fetch", help="fetch the logs of some days by a reader (module:function) and write them as Parquet")
    fetch.add_argument("reader")
    fetch.add_argument("path")
    fetch.add_argument("first")
    fetch.add_argument("last")
    fetch.add_argument("output")
    remote = commands.add_parser("remote", help="list a remote folder by a reader (module:function)")
    remote.add_argument("reader")
    remote.add_argument("path")
    remote.add_argument("--prefixes", nargs="*", default=[])
    commands.add_parser("ledger", help="print what is spent and what is still reserved").add_argument("root")
    cascade = commands.add_parser("cascade", help="build weekly and monthly digests from daily ones, only what follows from a change")
    cascade.add_argument("digests")
    cascade.add_argument("root")
    cascade.add_argument("--force", action="store_true")
    tidy = commands.add_parser("vacuum", help="delete the versions of a keyed table that are not retained")
    tidy.add_argument("root")
    tidy.add_argument("--keep", type=int, default=2)
    follow = commands.add_parser("watch-lines", help="print what a follower of a streaming query wrote")
    follow.add_argument("root")
    return parser


def _print(df) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))


def found(spark, tables: str, words: list[str], k: int, mode: str = "keyword", where: str | None = None, vector: int = 0):
    """(doc_id, score) of a search over the documents of a folder of tables."""
    from loomspan.operators import retrieval
    from loomspan.plans import registry

    docs = registry.table(spark, tables, "documents")
    allowed = docs.where(retrieval.metadata_filter(where, set(docs.columns) - {"text"})).select("doc_id") if where else None

    def semantic():
        near = retrieval.distances(registry.table(spark, tables, "embeddings"), registry._vector(spark, tables, vector))
        return near.select(F.col("vec_id").alias("doc_id"), "distance")

    return retrieval.search(mode, semantic, lambda: retrieval.keyword_scores(docs, [w.lower() for w in words]), k, allowed=allowed)


def reports(spark, asked: argparse.Namespace) -> None:
    """The commands that only read and print, or write one output."""
    from loomspan.adapters import models
    from loomspan.functions import calendar as cal
    from loomspan.operators import context, digests, index_page, indexing, manifests, metrics, retrieval
    from loomspan.plans import registry
    from loomspan.sources import files, sinks

    if asked.command == "context":
        docs = registry.table(spark, asked.tables, "documents")
        best = found(spark, asked.tables, asked.words, asked.top_k)
        rows = best.join(docs, "doc_id").withColumn("rank", -F.col("score"))
        head = context.passage_header({"source_type": F.col("source"), "filename": F.col("doc_id").cast("string")}, F.col("score"))
        for row in context.format_context(rows, [], ["rank", "doc_id"], head, F.col("text")).collect():
            print(row.context)
    elif asked.command == "index":
        indexing.index(spark.read.parquet(asked.papers), asked.root, models.HashEmbedder())
    elif asked.command == "status":
        _print(indexing.manifest(spark, asked.root).groupBy("state").agg(F.count("*").alias("papers"), F.sum("total").alias("passages")).orderBy("state"))
    elif asked.command == "failures":
        _print(indexing.manifest(spark, asked.root).where("state = 'failed'").select("paper", "error").orderBy("paper"))
    elif asked.command == "audit":
        _print(manifests.audit(indexing.manifest(spark, asked.root).select("paper", "total"), indexing.current_passages(spark, asked.root), "paper").where("problem <> 'ok'").orderBy("paper"))
    elif asked.command == "keyword-index":
        retrieval.keyword_index(spark.read.parquet(asked.documents), asked.root)
    elif asked.command == "keyword-search":
        _print(retrieval.indexed_scores(spark, asked.root, [w.lower() for w in asked.words]).orderBy(F.desc("score"), "doc_id").limit(asked.top_k))
    elif asked.command == "inventory":
        _print(metrics.inventory(files.inventory(spark, asked.root, asked.pattern)))
    elif asked.command == "cost":
        held = metrics.inventory(files.inventory(spark, asked.root, asked.pattern))
        _print(held.select("files", "bytes", "gib", metrics.storage_cost(F.col("bytes"), asked.days, asked.searches).alias("usd")))
    elif asked.command == "missing":
        today = F.to_date(F.lit(asked.today)) if asked.today else F.current_date()
        _print(cal.days_to_fetch(files.day_logs(spark, asked.logs).select("day"), today, F.to_date(F.lit(asked.since))).orderBy("day"))
    elif asked.command == "corpus":
        files.corpus(spark, asked.root, files.CORPORA[asked.shape]).write.parquet(asked.output)
    elif asked.command == "summarize":
        held = files.digests(spark, asked.digests, only_usable=True).withColumn("seconds", F.unix_micros("mtime"))
        parts = held.where("kind = 'daily'").select(cal.week_label(F.col("start")).alias("label"), F.col("label").alias("part"), "text", F.col("seconds").alias("mtime"))
        wholes = held.where("kind = 'weekly'").select("label", F.col("seconds").alias("mtime"), "text")
        sinks.write_lines(digests.build(digests.plan(parts, wholes), models.echo), asked.output)
    else:
        held = index_page.items(files.digests(spark, asked.digests).select("kind", "label", "text"))
        gone = index_page.missing(held, held.where("kind = 'daily'").select(F.col("start").alias("day")))
        sinks.write_text(spark, asked.output, index_page.page(index_page.payload(held, gone).first().payload))


def stores(spark, asked: argparse.Namespace) -> bool:
    """The commands on resumed indexes, vectors, pages, sources and ledgers; whether it was one of them."""
    from loomspan.adapters import models
    from loomspan.functions import markdown, tokens
    from loomspan.functions.text import revision
    from loomspan.operators import ann, cascade, chunking, ledger, passage_audit, resumable
    from loomspan.sources import files, keyed, remote
    from loomspan.streaming import progress

    def resume() -> None:
        print(json.dumps({"rounds": resumable.index(spark.read.parquet(asked.papers), asked.root, models.HashEmbedder(), asked.recipe, asked.batch, asked.rounds)}))

    def audit() -> None:
        no_link = F.lit(None).cast("string")
        sources = spark.read.parquet(asked.papers).select("paper", "text", "sha256", no_link.alias("link"))
        papers = passage_audit.papers_of(sources, revision(asked.recipe, F.coalesce("sha256", F.lit(""))))
        records = resumable.progress(spark, asked.root)
        stored = resumable.current_passages(spark, asked.root).select("id", "paper", "revision", "chunk", "char_start", "char_end", "document", no_link.alias("link"))
        audited = passage_audit.passages(stored, papers, records)
        _print(passage_audit.report(audited, passage_audit.checkpoints(audited, papers, records), records, resumable.progress(spark, asked.root)))

    def nearest() -> None:
        query = spark.read.parquet(asked.vectors).where(F.col("vec_id") == asked.vec_id).select(F.col("vec_id").alias("query_id"), "embedding").limit(1)
        _print(ann.search(spark, asked.root, query, asked.top_k, asked.probes).orderBy("rank"))

    def counted() -> None:
        n = spark.read.parquet(asked.texts).select(tokens.count(F.col("text")).alias("n"))
        windows = chunking.window_count(F.col("n"), asked.size, asked.overlap)
        told = n.agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"), F.sum(windows).alias("windows"), F.sum(chunking.submitted_tokens(F.col("n"), F.col("n"), asked.size, asked.overlap)).alias("submitted"))
        _print(told.withColumn("cost", F.col("submitted") / 1e6 * asked.price))

    def fetch() -> None:
        remote.register(spark)
        spark.read.format("daylogs").options(reader=asked.reader, path=asked.path, first=asked.first, last=asked.last).load().write.parquet(asked.output)

    def cascaded() -> None:
        held = files.digests(spark, asked.digests, only_usable=True).where("kind = 'daily'")
        _print(cascade.run(held.select("label", "text"), cascade.calendar_parts(held.select(F.col("start").alias("day"))), asked.root, models.echo, force=asked.force).orderBy("kind", "label"))

    def paged() -> None:
        found = spark.read.parquet(asked.pages)
        found.select("page_id", markdown.markdown_of(F.col("html"), F.col("url"), asked.most).alias("markdown")).write.parquet(asked.output)

    known = {
        "resume": resume, "progress": lambda: _print(resumable.progress(spark, asked.root).select("paper", "state", "next_chunk", "total", "error").orderBy("paper")), "audit-passages": audit,
        "vector-index": lambda: ann.build(spark.read.parquet(asked.vectors), asked.root), "vector-search": nearest, "markdown": paged, "tokens": counted, "fetch": fetch,
        "remote": lambda: _print(remote.inventory(spark, asked.reader, asked.path, asked.prefixes).orderBy("path")), "ledger": lambda: _print(ledger.usage(ledger.fold(ledger.Ledger(spark, asked.root, 1.0).events()))),
        "cascade": cascaded, "vacuum": lambda: print(json.dumps({"dropped": keyed.vacuum(spark, asked.root, asked.keep)})), "watch-lines": lambda: _print(progress.lines(spark, asked.root).orderBy("number")),
    }
    if asked.command not in known:
        return False
    known[asked.command]()
    return True


def preprocess(spark, logs: str, output: str, most: int, overlap: int) -> None:
    from loomspan.operators import chunking
    from loomspan.sources import files, sinks

    parsed = chunking.parse_lines(files.day_logs(spark, logs).select(F.col("day").alias("log_id"), "raw"))
    messages = parsed.select(F.unix_date("log_id").cast("long").alias("conv_id"), F.col("line_no").cast("long").alias("turn"), F.col("message").alias("text"))
    chunks = chunking.message_chunks(messages, most, overlap)
    day = F.date_from_unix_date(F.col("conv_id").cast("int")).cast("string")
    sinks.write_lines(chunks.select(day.alias("file"), F.col("chunk").alias("index"), F.col("first_message").alias("start"), F.col("end_message").alias("end"), F.col("chunk_text").alias("text")), output)


def main(argv: list[str] | None = None) -> int:
    from loomspan.plans import catalogue, indexes, publishing, registry, reports  # noqa: F401  all register queries

    asked = _parser().parse_args(argv)
    if asked.command == "queries":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = build_session("loomspan-cli")
    if asked.command == "run":
        if asked.name not in registry.QUERIES:
            raise SystemExit(f"no query named {asked.name}")
        registry.QUERIES[asked.name](spark, asked.tables).write.parquet(asked.output)
    elif asked.command == "preprocess":
        preprocess(spark, asked.logs, asked.output, asked.max_tokens, asked.overlap)
    elif asked.command == "search":
        _print(found(spark, asked.tables, asked.words, asked.top_k, asked.mode, asked.filter, asked.vector))
    elif not stores(spark, asked):
        reports(spark, asked)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
