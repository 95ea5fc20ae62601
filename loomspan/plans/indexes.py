"""Queries on the index: approximate search, audits of passages, resumed runs, keyed stores, ledgers, cascades of digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.adapters import models
from loomspan.functions import markdown
from loomspan.operators import ann, cascade, chunking, ledger, passage_audit, resumable, retrieval
from loomspan.plans.catalogue import _BAD, _TOKENS
from loomspan.plans.registry import query, table
from loomspan.sources import keyed


def _index(spark, d) -> tuple[DataFrame, DataFrame, str]:
    vectors = table(spark, d, "embeddings")
    root = scratch.fresh_path(spark, "ann")
    ann.build(vectors, root)
    return vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), root  # the stated query set


@query()
def knn_index(spark, d):
    """The nearest 10 that the index finds for each stated query; exact distances of an approximate choice, so SQL has no twin."""
    _, queries, root = _index(spark, d)
    return ann.search(spark, root, queries, 10).select("query_id", "vec_id", "rank", (F.round("distance", 5) + F.lit(0.0)).alias("distance"))


@query("SELECT count(*) AS queries, true AS recalled, true AS pruned FROM embeddings WHERE vec_id % 50 = 0")
def knn_index_recall(spark, d):
    """Whether the index finds 0.95 of the exact nearest 10 and reads at most a quarter of its lists."""
    vectors, queries, root = _index(spark, d)
    exact = retrieval.batch_top_k(vectors, queries, 10)
    told = ann.quality(ann.search(spark, root, queries, 10), exact, ann.load(spark, root)[1], 10)
    return told.select("queries", (F.col("recall") >= 0.95).alias("recalled"), (F.col("share") <= 0.25).alias("pruned"))


def _audited(spark, d, harmed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages, papers, records) of the documents in windows of characters; `harmed` damages some of them, each kind in its own way."""
    k = F.col("doc_id") % 23 if harmed else F.lit(0)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper"), k.alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    link = F.concat(F.lit("https://x.org/"), "paper")
    rev = F.sha2(F.concat(F.lit("r"), "sha256"), 256)
    papers = passage_audit.papers_of(docs.select("paper", "text", link.alias("link"), F.when(F.col("k") == 12, "other").otherwise(digest).alias("sha256")), rev)
    n = F.when(F.length("text") == 0, 0).otherwise(1 + F.ceil(F.greatest(F.lit(0), F.length("text") - 400) / 350)).cast("long")
    whole = docs.select("paper", "k", "text", link.alias("link"), n.alias("n"), F.when(F.col("k") == 12, "other").otherwise(digest).alias("sha256")).withColumn("rev", rev)
    at = whole.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i")).where("NOT (k = 8 AND i = 1)")
    a, first = F.col("i") * 350, F.col("i") == 0
    b = F.least(a + 400, F.length("text"))
    chunk = F.when(first & (F.col("k") == 2), -1).when(~(first & (F.col("k") == 3)), F.col("i")).cast("long")
    document = F.concat(F.substring("text", a + 1, b - a), F.when(first & (F.col("k") == 1), "~").otherwise(""))
    stored = at.select(
        F.concat_ws(":", F.sha2(F.col("paper").cast("binary"), 256), "rev", chunk.cast("string")).alias("id"), F.when(first & (F.col("k") == 9), F.concat(F.lit("gone-"), "paper")).otherwise(F.col("paper")).alias("paper"),
        F.when(first & (F.col("k") == 6), "old").otherwise(F.col("rev")).alias("revision"), chunk.alias("chunk"), a.cast("long").alias("char_start"),
        F.when((F.col("k") == 7) & (F.col("i") == F.col("n") - 1), b + 5).otherwise(b).cast("long").alias("char_end"), document.alias("document"),
        F.when(first & (F.col("k") == 5), "other").otherwise(F.col("link")).alias("link"), F.explode(F.expr("array_repeat(0, IF(k = 4 AND i = 0, 2, 1))")).alias("copy"),
    ).drop("copy")
    total = F.col("n") + F.expr("IF(k = 10, 1, 0)")
    records = whole.select("paper", F.expr("IF(k = 13, 'old', rev)").alias("revision"), (total - F.expr("IF(k = 11, 1, 0)")).alias("next_chunk"), total.alias("total"), F.lit("ready").alias("state"))
    return scratch.materialize(passage_audit.passages(stored, papers, records), "audited", free=True), papers, records


def _audit_sql(k: str) -> str:
    return rf"""d AS (SELECT CAST(doc_id AS VARCHAR) AS paper, {k} AS k, coalesce(text, '') AS t FROM documents),
 x AS (SELECT *, length(t) AS len, {_BAD} AS bad, sha256('r' || CASE WHEN k = 12 THEN 'other' ELSE sha256(t) END) AS rev, CASE WHEN length(t) = 0 THEN 0 ELSE 1 + CAST(ceil(greatest(0, length(t) - 400) / 350.0) AS BIGINT) END AS n FROM d),
 p AS (SELECT *, bad >= 32 AND bad > 0.01 * len AND k <> 12 AS skipped, n + CASE WHEN k = 10 THEN 1 ELSE 0 END AS total FROM x),
 w AS (SELECT *, i * 350 AS a, least(i * 350 + 400, len) AS b FROM (SELECT *, unnest(range(0, n)) AS i FROM p) WHERE NOT (k = 8 AND i = 1)),
 s0 AS (SELECT CASE WHEN k = 9 AND i = 0 THEN 'gone-' || paper ELSE paper END AS paper, paper AS own, rev AS right_rev, CASE WHEN k = 6 AND i = 0 THEN 'old' ELSE rev END AS revision, CASE WHEN k = 2 AND i = 0 THEN -1 WHEN k = 3 AND i = 0 THEN NULL ELSE i END AS chunk,
  a, CASE WHEN k = 7 AND i = n - 1 THEN b + 5 ELSE b END AS b, substr(t, a + 1, b - a) || CASE WHEN k = 1 AND i = 0 THEN '~' ELSE '' END AS document, k = 5 AND i = 0 AS bad_link, k = 4 AND i = 0 AS doubled FROM w),
 s AS (SELECT * FROM s0 UNION ALL SELECT * FROM s0 WHERE doubled),
 o AS (SELECT s.*, row_number() OVER (PARTITION BY own, chunk ORDER BY s.paper) AS nth, lag(a) OVER (PARTITION BY s.paper, coalesce(chunk, -1) >= 0 ORDER BY chunk) AS a0, lag(chunk) OVER (PARTITION BY s.paper, coalesce(chunk, -1) >= 0 ORDER BY chunk) AS c0, lag(b, 1, 0) OVER (PARTITION BY s.paper, coalesce(chunk, -1) >= 0 ORDER BY chunk) AS b0 FROM s),
 q AS (SELECT o.paper, o.chunk, CASE WHEN p.paper IS NULL THEN 'unknown paper' WHEN skipped THEN 'unreadable paper' WHEN revision <> rev THEN 'identity' WHEN nth > 1 THEN 'duplicate' WHEN chunk IS NULL OR chunk < 0 OR chunk >= total THEN 'number'
   WHEN b > len OR substr(t, a + 1, b - a) <> document THEN 'text' WHEN bad_link THEN 'link' END AS problem,
  coalesce(chunk, -1) >= 0 AND (coalesce(a <= a0 AND chunk > c0, false) OR (p.paper IS NOT NULL AND a > b0 AND regexp_matches(substr(t, b0 + 1, a - b0), '[^\s\p{{Z}}]'))) AS gap FROM o LEFT JOIN p ON o.paper = p.paper),
 c AS (SELECT p.paper, p.skipped, CASE WHEN skipped THEN 0 ELSE total END AS total, CASE WHEN k = 12 THEN 'changed since conversion' WHEN skipped THEN CASE WHEN stored > 0 THEN 'unreadable but stored' END WHEN k IN (11, 13) OR total < 1 THEN 'checkpoint'
   WHEN coalesce(found, 0) <> total THEN 'count' WHEN gaps > 0 THEN 'gap' END AS problem FROM p LEFT JOIN (SELECT paper, count(*) AS stored, count(*) FILTER (WHERE problem IS NULL) AS found, count(*) FILTER (WHERE gap) AS gaps FROM q GROUP BY paper) g ON g.paper = p.paper
  UNION ALL SELECT DISTINCT paper, false, 0, 'unknown paper' FROM q WHERE problem = 'unknown paper')"""


@query(f"""WITH {_audit_sql('doc_id % 23')} SELECT 'passage' AS level, coalesce(problem, 'ok') AS problem, count(*) AS n, count(*) FILTER (WHERE gap) AS gaps FROM q GROUP BY problem
 UNION ALL SELECT 'paper', coalesce(problem, 'ok'), count(*), 0 FROM c GROUP BY problem""")
def passage_audit_kinds(spark, d):
    """What is wrong with damaged passages and checkpoints, by kind."""
    audited, papers, records = _audited(spark, d, True)
    checked = passage_audit.checkpoints(audited, papers, records)
    kind = F.coalesce("problem", F.lit("ok")).alias("problem")
    one = audited.groupBy(F.lit("passage").alias("level"), kind).agg(F.count("*").alias("n"), F.count_if("gap").alias("gaps"))
    return one.unionByName(checked.groupBy(F.lit("paper").alias("level"), kind).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("gaps")))


def _report_sql(run: str, stable: str) -> str:
    return f"""SELECT '{run}' AS run, (SELECT count(*) FROM p) AS papers, (SELECT count(*) FROM p WHERE skipped) AS skipped, (SELECT CAST(sum(total) AS BIGINT) FROM c) AS expected, (SELECT count(*) FROM q) AS passages, (SELECT count(*) FROM q WHERE gap) AS gaps,
 e.n AS n_errors, {stable} AS stable, least(e.n, 100) AS listed, coalesce(e.first, '') AS first_error, e.n = 0 AND {stable} AND (SELECT count(*) FROM p WHERE skipped) = 0 AS all_ready, e.n = 0 AND {stable} AS all_eligible
 FROM (SELECT count(*) AS n, min(paper) AS first FROM (SELECT paper FROM q WHERE problem IS NOT NULL UNION ALL SELECT paper FROM c WHERE problem IS NOT NULL)) e"""


@query(f"""SELECT * FROM (WITH {_audit_sql('doc_id % 23')} {_report_sql('harmed', 'false')}) UNION ALL SELECT * FROM (WITH {_audit_sql('0')} {_report_sql('sound', 'true')})""")
def passage_audit_report(spark, d):
    """Reports on damaged records that move meanwhile, and on sound ones that do not; texts without a passage are errors in both."""
    out = None
    for run, harmed in (("harmed", True), ("sound", False)):
        audited, papers, records = _audited(spark, d, harmed)
        checked = passage_audit.checkpoints(audited, papers, records)
        after = records.withColumn("state", F.expr("IF(total % 2 = 1, 'failed', state)")) if harmed else records
        told = passage_audit.report(audited, checked, records, after).withColumn("run", F.lit(run))
        out = told if out is None else out.unionByName(told)
    first = F.when(F.size("errors") > 0, F.split(F.element_at("errors", 1), r" \| ", 2)[0]).otherwise("")
    return out.select("run", "papers", "skipped", "expected", "passages", "gaps", "n_errors", "stable", F.size("errors").cast("long").alias("listed"), first.alias("first_error"), "all_ready", "all_eligible")


# stores


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'newest' ELSE 'old' END AS origin, list_sum(embedding) IS NOT NULL AS whole FROM embeddings WHERE (vec_id % 5 <> 4 OR vec_id % 3 = 0) AND vec_id % 7 <> 6""")
def keyed_upsert(spark, d):
    """Vectors in a keyed table: an upsert that names ids repeatedly, and one that deletes some."""
    where = scratch.fresh_path(spark, "keyed")
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    keyed.upsert(vectors.where("vec_id % 5 <> 4").withColumn("origin", F.lit("old")), where, ["vec_id"])
    fresh = vectors.where("vec_id % 3 = 0").select("*", F.explode(F.array(F.lit("new"), F.lit("newest"))).alias("origin"))
    keyed.upsert(fresh, where, ["vec_id"], order=F.length("origin"))
    keyed.upsert(vectors.where("vec_id % 7 = 6").withColumn("origin", F.lit("gone")), where, ["vec_id"], deleted=F.lit(True))
    return keyed.read(spark, where, "vec_id long, embedding array<float>, origin string").select("vec_id", "origin", F.col("embedding").isNotNull().alias("whole"))


_KIND = "CASE l_linenumber WHEN 1 THEN 'reserve' WHEN 2 THEN 'settle' WHEN 3 THEN 'refund' WHEN 4 THEN 'fail' ELSE 'note' END"


@query(f"""WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, {_KIND} AS kind, CAST(l_quantity AS DOUBLE) AS amount, l_partkey AS tokens FROM lineitem WHERE l_orderkey % 4 < l_linenumber + 1)
 SELECT id, coalesce(max(amount) FILTER (WHERE kind = 'reserve'), 0) AS reserved, CASE WHEN bool_or(kind = 'settle') THEN max(amount) FILTER (WHERE kind = 'settle') WHEN bool_or(kind = 'refund') THEN 0 END AS cost,
 max(tokens) AS tokens, CASE WHEN bool_or(kind = 'settle') THEN 'received' WHEN bool_or(kind = 'refund') THEN 'refunded' WHEN bool_or(kind = 'fail') THEN 'failed' ELSE 'reserved' END AS state FROM e GROUP BY id""")
def ledger_fold(spark, d):
    """A log of reservations, settlements, refunds and failures folded by reservation; some have no beginning, some no end."""
    lines = table(spark, d, "lineitem").where("l_orderkey % 4 < l_linenumber + 1")
    events = lines.select(F.col("l_orderkey").cast("string").alias("id"), F.expr(_KIND).alias("kind"), F.col("l_quantity").cast("double").alias("amount"), F.col("l_partkey").cast("long").alias("tokens"))
    return ledger.fold(events)


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN coalesce(text, '') || ' more' ELSE coalesce(text, '') END AS t, doc_id % 17 = 3 AS tampered FROM documents),
 n AS (SELECT *, {_TOKENS} AS n, {_BAD} AS x FROM d), e AS (SELECT *, CASE WHEN tampered THEN 'changed since conversion' WHEN x >= 32 AND x > 0.01 * length(t) THEN 'unreadable' WHEN n = 0 THEN 'no text to embed' END AS error FROM n),
 s AS (SELECT *, CAST(CASE WHEN error IS NULL THEN 1 + ceil(greatest(0, n - 175) / 155.0) ELSE 0 END AS BIGINT) AS total FROM e)
 SELECT CAST(doc_id AS VARCHAR) AS paper, CASE WHEN error IS NULL THEN 'ready' ELSE 'failed' END AS state, coalesce(error, '') AS error, total, total AS next_chunk, CAST(ceil(total / 40.0) AS BIGINT) AS rounds, total AS stored FROM s""")
def index_resumed(spark, d):
    """An index that stops after its first round of 40 passages a paper, finds a tenth of its papers changed, and goes on."""
    root = scratch.fresh_path(spark, "resumed")
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("paper"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.when(F.col("doc_id") % 17 == 3, F.lit("other")).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    model = models.HashEmbedder(8)
    resumable.index(docs.withColumn("sha256", digest), root, model, batch=40, rounds=1)
    changed = docs.withColumn("text", F.expr("IF(doc_id % 10 = 0, concat(text, ' more'), text)"))
    resumable.index(changed.withColumn("sha256", digest), root, model, batch=40)
    stored = resumable.current_passages(spark, root).groupBy("paper").agg(F.countDistinct("chunk").alias("stored"))
    held = resumable.progress(spark, root).join(stored, "paper", "left")
    return held.select("paper", "state", F.coalesce("error", F.lit("")).alias("error"), "total", "next_chunk", F.size("rounds").cast("long").alias("rounds"), F.coalesce("stored", F.lit(0)).cast("long").alias("stored"))


# texts


@query()
def token_windows(spark, d):
    """Windows of 175 tokens of the vocabulary file; SQL has no byte-pair tokens."""
    return chunking.token_windows(table(spark, d, "documents"), 175, 20)


@query()
def page_markdown(spark, d):
    """Every page as Markdown; SQL cannot say it."""
    return table(spark, d, "pages").select("page_id", markdown.markdown_of(F.col("html"), F.col("url")).alias("markdown"))


# digests


def _hashed(prompt: str) -> str:
    """A stand-in whose text follows from all that it was asked."""
    return "Digest " + hashlib.sha256(prompt.encode()).hexdigest()


@query("""WITH p AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), w AS (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS a FROM p), c AS (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS a FROM p WHERE day(day) = 15),
 m AS (SELECT DISTINCT a, unnest([strftime(a, '%Y-%m'), strftime(a + 6, '%Y-%m')]) AS month FROM w), x AS (SELECT DISTINCT month FROM m SEMI JOIN c USING (a)),
 n AS (SELECT (SELECT count(*) FROM w) AS w, (SELECT count(*) FROM c) AS c, (SELECT count(DISTINCT month) FROM m) AS m, (SELECT count(*) FROM x) AS x)
 SELECT run, kind, state, n FROM (SELECT 1 AS run, 'weekly' AS kind, 'generated' AS state, w AS n FROM n UNION ALL SELECT 1, 'monthly', 'generated', m FROM n UNION ALL SELECT 2, 'weekly', 'generated', c FROM n UNION ALL SELECT 2, 'weekly', 'reused', w - c FROM n
 UNION ALL SELECT 2, 'monthly', 'generated', x FROM n UNION ALL SELECT 2, 'monthly', 'reused', m - x FROM n UNION ALL SELECT 3, 'weekly', 'reused', w FROM n UNION ALL SELECT 3, 'monthly', 'reused', m FROM n) WHERE n > 0""")
def digest_cascade(spark, d):
    """Digests of all days' weeks and months, again after every 15th changed, and once more: each run writes only what follows from a change."""
    root = scratch.fresh_path(spark, "cascade")
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.concat(F.count("*").cast("string"), F.lit(" events")).alias("text"))
    days = scratch.materialize(days, "days")
    later = days.withColumn("text", F.when(F.dayofmonth("day") == 15, F.concat("text", F.lit(", changed"))).otherwise(F.col("text")))
    parts, out = cascade.calendar_parts(days), None
    for number, texts in enumerate((days, later, later), 1):
        told = cascade.run(texts.select(F.col("day").cast("string").alias("label"), "text"), parts, root, _hashed)
        counts = scratch.materialize(told.groupBy("kind", "state").agg(F.count("*").alias("n")), "counts").withColumn("run", F.lit(number))
        out = counts if out is None else out.unionByName(counts)
    return out.select("run", "kind", "state", "n")
