"""Further queries: uploads, reconciliation, catalogue views, link counts, page metadata, embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.adapters import models
from loomspan.functions import calendar as cal
from loomspan.functions import text as tx
from loomspan import scratch
from loomspan.operators import citations, digests, indexing, manifests, metrics, uploads
from loomspan.plans.registry import _BINARY, _MIXED, _SCHOLARLY, mixed_links, query, table

_PATH = "source || '/' || doc_id || CASE WHEN doc_id % 23 = 0 THEN '.txt' ELSE '.md' END"
_PHASE = "CASE doc_id % 6 WHEN 0 THEN 'ready' WHEN 1 THEN 'uploading' WHEN 2 THEN 'uploaded' WHEN 3 THEN 'updating' WHEN 4 THEN 'failed' ELSE 'ready' END"
_FILE = "CASE WHEN doc_id % 6 = 1 THEN NULL ELSE 'file-' || doc_id END"


def _inputs(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return docs.select(F.expr(_PATH).alias("path"), digest.alias("sha256"), F.octet_length("text").alias("size_bytes"), (F.length(tx.strip(F.col("text"))) == 0).alias("blank"))


def _manifest(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id % 9 <> 0")
    digest = F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    return docs.select(F.expr(_PATH).alias("path"), digest.alias("sha256"), F.expr(_FILE).alias("file_id"), F.expr(_PHASE).alias("phase"), F.octet_length("text").cast("long").alias("size_bytes"))


@query(rf"""WITH i AS (SELECT {_PATH} AS path, sha256(text) AS sha, octet_length(encode(text)) AS size, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) = 0 AS blank FROM documents),
 m AS (SELECT {_PATH} AS path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS old, {_FILE} AS file_id, {_PHASE} AS phase FROM documents WHERE doc_id % 9 <> 0),
 b AS (SELECT i.path, coalesce(phase, 'new') AS p, file_id IS NULL AS nofile, coalesce(old <> sha, false) AS changed, old IS NOT NULL AS known, size, blank FROM i LEFT JOIN m ON i.path = m.path),
 a AS (SELECT *, CASE WHEN NOT suffix(lower(path), '.md') THEN 'not markdown' WHEN size > 20000 THEN 'too large' WHEN blank THEN 'empty' WHEN known AND NOT changed AND p = 'ready' THEN 'unchanged'
  WHEN nofile AND p = 'uploading' THEN 'reconcile' ELSE 'send' END AS action FROM b)
 SELECT path, action, CASE WHEN action <> 'send' THEN '' ELSE concat_ws(',', CASE WHEN nofile THEN 'upload' END, CASE WHEN nofile OR p = 'uploaded' THEN 'attach' END,
  CASE WHEN changed OR p = 'updating' THEN 'update' WHEN NOT nofile AND p = 'failed' THEN 'reindex' END, 'poll') END AS steps FROM a""")
def upload_plan(spark, d):
    return uploads.plan(_inputs(spark, d), _manifest(spark, d), retry_failed=True, most_bytes=20_000)


@query(f"""SELECT {_PATH} AS path, octet_length(encode(text)) AS size_bytes FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 6 <> 1 AND lang <> 'en'""")
def retained_remote(spark, d):
    now = table(spark, d, "documents").where("lang = 'en'").select(F.expr(_PATH).alias("path"))
    return uploads.retained(_manifest(spark, d), now)


@query("""WITH r AS (SELECT sha256(text) AS name, 'file-' || doc_id AS file_id FROM documents WHERE doc_id % 4 <> 0), w AS (SELECT doc_id, sha256(text) AS name FROM documents WHERE doc_id % 3 = 0)
 SELECT doc_id, min(file_id) AS file_id FROM w JOIN r USING (name) GROUP BY doc_id HAVING count(*) = 1""")
def name_reconcile(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("name"))
    remote = docs.where("doc_id % 4 <> 0").select("name", F.concat(F.lit("file-"), F.col("doc_id").cast("string")).alias("file_id"))
    return manifests.reconcile(docs.where("doc_id % 3 = 0"), remote, "doc_id")


@query(f"""WITH c AS (SELECT CASE WHEN {_BINARY} THEN 'binary' WHEN page_id % 13 = 0 THEN 'skipped' WHEN suffix(lower(url), '.pdf') THEN 'pdf' ELSE 'html' END AS kind, ({_SCHOLARLY}) AS scholarly, page_id % 7 = 0 AS failed, length(html) AS tokens FROM {_MIXED})
 SELECT count(*) FILTER (WHERE scholarly) AS papers, count(*) FILTER (WHERE kind = 'pdf') AS pdfs, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE NOT failed AND kind <> 'pdf') AS ok,
 CAST(coalesce(sum(tokens) FILTER (WHERE NOT failed AND kind <> 'pdf'), 0) AS BIGINT) AS text_tokens FROM c WHERE kind NOT IN ('binary', 'skipped')""")
def link_stats(spark, d):
    u = F.col("url")
    kind = F.when(tx.is_binary(u), "binary").when(F.col("page_id") % 13 == 0, "skipped").when(tx.is_pdf(u, F.lit(None).cast("string")), "pdf").otherwise("html")
    error = F.when(F.col("page_id") % 7 == 0, "HTTP 500")
    return metrics.link_counts(mixed_links(spark, d).select(kind.alias("kind"), error.alias("error"), tx.is_scholarly(u).alias("scholarly"), F.length("html").cast("long").alias("tokens")))


@query("""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_totalprice > 100000 AS hit FROM orders), g AS (SELECT day, bool_or(hit) AS hit FROM o GROUP BY day)
 SELECT CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
 coalesce(string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) FILTER (WHERE NOT hit), '') AS missing FROM g GROUP BY 1, 2""")
def catalog_calendar(spark, d):
    orders = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.bool_or(F.col("o_totalprice") > 100000).alias("hit"))
    gone = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("day").cast("string")))), ",")
    return orders.groupBy(F.year("day").alias("year"), F.month("day").alias("month")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), gone.alias("missing"))


@query("""WITH c AS (SELECT CASE WHEN length(text) < 50 THEN 'unusable' WHEN doc_id % 7 = 0 THEN 'forced' WHEN l.doc_id IS NULL THEN 'stale' ELSE 'reused' END AS state FROM (SELECT doc_id, trim(text) AS text FROM documents)
 LEFT JOIN labels l USING (doc_id)) SELECT state, count(*) AS n FROM c GROUP BY state""")
def rebuild_counts(spark, d):
    done = table(spark, d, "labels").select("doc_id", F.lit(True).alias("fresh"))
    docs = table(spark, d, "documents").join(done, "doc_id", "left")
    return docs.withColumn("forced", F.col("doc_id") % 7 == 0).groupBy(metrics.rebuild_states().alias("state")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'), w AS (SELECT CAST(date_trunc('week', day) AS DATE) AS monday, day FROM (SELECT DISTINCT day FROM e))
 SELECT strftime(monday, '%G-W%V') AS week, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS days FROM w GROUP BY monday""")
def week_days(spark, d):
    days = table(spark, d, "events").where("event_type = 'purchase'").select(F.to_date("ts").alias("day")).distinct()
    return days.groupBy(cal.week_label(F.col("day")).alias("week")).agg(F.array_join(F.array_sort(F.collect_list(F.col("day").cast("string"))), ",").alias("days"))


@query()
def answer_links(spark, d):
    pages = table(spark, d, "pages").where("url IS NOT NULL")
    text = F.concat(F.lit("**Answer**\nSee [1] and [2], not `[1]`.\n- "), F.coalesce(tx.html_title(F.col("html")), F.lit("")), F.lit(" [1-1]"))
    return citations.link_answers(pages.select(F.col("page_id").alias("key"), text.alias("answer"), F.array("url").alias("urls")))


@query()
def embed_messages(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), "text")
    return models.embed(rows, models.HashEmbedder(16))


_TOKENS = "len(regexp_extract_all(t, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'))"
_BAD = "length(t) - length(regexp_replace(t, '[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}\\x{FFFD}]', '', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' more' ELSE text END AS t, doc_id % 17 = 3 AS tampered FROM documents),
 n AS (SELECT *, {_TOKENS} AS n, {_BAD} AS x FROM d), e AS (SELECT *, CASE WHEN tampered THEN 'changed since conversion' WHEN x >= 32 AND x > 0.01 * length(t) THEN 'unreadable' WHEN n = 0 THEN 'no text to embed' END AS error FROM n)
 SELECT CAST(doc_id AS VARCHAR) AS paper, CASE WHEN error IS NULL THEN 'ready' ELSE 'failed' END AS state, coalesce(error, '') AS error,
 CAST(CASE WHEN error IS NULL THEN 1 + ceil(greatest(0, n - 175) / 155.0) ELSE 0 END AS BIGINT) AS stored FROM e""")
def index_incremental(spark, d):
    """Half of the papers, then all, some of them changed: what the manifest and the store hold in the end."""
    root = scratch.fresh_path(spark, "index")
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("paper"), "text")
    digest = F.when(F.col("doc_id") % 17 == 3, F.lit("other")).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    model = models.HashEmbedder(16)
    indexing.index(docs.where("doc_id % 2 = 0").withColumn("sha256", digest), root, model)
    changed = docs.withColumn("text", F.expr("IF(doc_id % 10 = 0, concat(text, ' more'), text)"))
    indexing.index(changed.withColumn("sha256", digest), root, model)
    stored = indexing.current_passages(spark, root).groupBy("paper").agg(F.count("*").alias("stored"))
    held = indexing.manifest(spark, root).join(stored, "paper", "left")
    return held.select("paper", "state", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("stored", F.lit(0)).cast("long").alias("stored"))


_DAY_TEXT = "count(*) || ' purchases of ' || count(DISTINCT user_id) || ' people on this day, as the log has them.'"


@query(f"""WITH p AS (SELECT CAST(ts AS DATE) AS day, {_DAY_TEXT} AS text, max(event_id) AS mtime FROM events WHERE event_type = 'purchase' GROUP BY 1),
 g AS (SELECT strftime(day, '%G-W%V') AS label, max(mtime) AS newest, min(mtime) AS oldest, string_agg('## ' || CAST(day AS VARCHAR) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY day) AS block FROM p GROUP BY 1),
 w AS (SELECT label, block, CASE WHEN oldest % 2 = 0 THEN newest ELSE newest - 1 END >= newest AS keep FROM g)
 SELECT label, CASE WHEN keep THEN 'reused' ELSE 'generated' END AS state,
 CASE WHEN keep THEN 'An older digest of the week that is long enough to be used again.' ELSE 'Summary: ' || right('Digest of ' || label || chr(10) || block, 400) END AS text FROM w""")
def digest_build(spark, d):
    days = table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day"))
    parts = days.agg(
        F.concat(F.count("*").cast("string"), F.lit(" purchases of "), F.countDistinct("user_id").cast("string"), F.lit(" people on this day, as the log has them.")).alias("text"),
        F.max("event_id").alias("mtime"),
    )
    parts = parts.select(cal.week_label(F.col("day")).alias("label"), F.col("day").cast("string").alias("part"), "text", "mtime")
    wholes = parts.groupBy("label").agg(F.expr("IF(min(mtime) % 2 = 0, max(mtime), max(mtime) - 1)").alias("mtime"))
    wholes = wholes.withColumn("text", F.lit("An older digest of the week that is long enough to be used again."))
    return digests.build(digests.plan(parts, wholes), models.echo)
