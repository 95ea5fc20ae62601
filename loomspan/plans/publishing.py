"""Queries on what is published: the list of digests, cached page batches, links in Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import calendar as cal
from loomspan.functions import text as tx
from loomspan.operators import index_page, page_cache
from loomspan.plans.registry import query, table

_DAY = r"CAST(ts AS DATE)"


@query(f"""WITH e AS (SELECT DISTINCT {_DAY} AS day FROM events), p AS (SELECT DISTINCT {_DAY} AS day FROM events WHERE event_type = 'purchase' AND value > 90),
 g AS (SELECT 'daily' AS kind, CAST(day AS VARCHAR) AS label, day AS start, day AS "end" FROM p UNION SELECT 'weekly', strftime(day, '%G-W%V'), CAST(date_trunc('week', day) AS DATE), CAST(date_trunc('week', day) AS DATE) + 6 FROM p WHERE day(day) > 7),
 s AS (SELECT min(day) AS a, max(day) AS b FROM e), x AS (SELECT 'daily' AS kind, CAST(day AS VARCHAR) AS label FROM e
 UNION SELECT 'weekly', strftime(d, '%G-W%V') FROM (SELECT unnest(generate_series(date_trunc('week', a), date_trunc('week', b), INTERVAL 7 DAY)) AS d FROM s)
 UNION SELECT 'monthly', strftime(d, '%Y-%m') FROM (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS d FROM s))
 SELECT kind, label, 'generated' AS state, kind || '-' || label || '.html' AS href, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end",
 CASE WHEN kind = 'daily' THEN 'Day ' || label ELSE label END AS title FROM g
 UNION ALL SELECT kind, label, 'missing', NULL, NULL, NULL, NULL FROM x ANTI JOIN g USING (kind, label)""")
def digest_catalog(spark, d):
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = events.where("event_type = 'purchase' AND value > 90").select("day").distinct()
    label = F.col("day").cast("string")
    daily = days.select(F.lit("daily").alias("kind"), label.alias("label"), F.concat(F.lit("text\n ## Day "), label, F.lit("\n# more")).alias("text"))
    weekly = days.where("day(day) > 7").select(F.lit("weekly").alias("kind"), cal.week_label(F.col("day")).alias("label"), F.lit("no heading").alias("text")).distinct()
    found = index_page.items(daily.unionByName(weekly))
    gone = index_page.missing(found, events.select("day").distinct())
    listed = found.select("kind", "label", F.lit("generated").alias("state"), "href", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "title")
    return listed.unionByName(gone.select("kind", "label", F.lit("missing").alias("state")), allowMissingColumns=True)


@query("""WITH d AS (SELECT doc_id, n_chars // 50 AS pages FROM documents), b AS (SELECT doc_id, pages, unnest(range(0, pages, 20)) AS first FROM d)
 SELECT doc_id, first, least(first + 20, pages) AS "end", CASE WHEN doc_id % 5 = 4 OR first % 3 = 0 THEN 'render' ELSE 'kept' END AS state FROM b""")
def page_batch_plan(spark, d):
    """Batches of which some are kept and some of these damaged."""
    wanted = page_cache.batches(table(spark, d, "documents").select("doc_id", F.expr("n_chars div 50").alias("pages")))
    kept = wanted.where("first % 3 <> 0").withColumn("markdown", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("first").cast("string")))
    cache = page_cache.record(kept).withColumn("sha256", F.expr("IF(doc_id % 5 = 4, 'damaged', sha256)"))
    return page_cache.plan(wanted, cache).drop("markdown")


@query(r"""WITH t AS (SELECT page_id, 'see ' || url || ' ' || regexp_replace(url, '^https?://', 'www.') || ' (' || url || ')' AS t FROM pages)
 SELECT page_id, regexp_replace(regexp_replace(t, '(^|[ \t\n\r\f])(www\.[^ \t\n\r\f]*)', '\1[\2](https://\2)', 'g'), '(^|[ \t\n\r\f])((?:https?|ftp)://[^ \t\n\r\f]*)', '\1[\2](\2)', 'g') AS text FROM t""")
def auto_links(spark, d):
    url = F.col("url")
    text = F.concat(F.lit("see "), url, F.lit(" "), F.regexp_replace(url, "^https?://", "www."), F.lit(" ("), url, F.lit(")"))
    return table(spark, d, "pages").select("page_id", tx.auto_link(text).alias("text"))
