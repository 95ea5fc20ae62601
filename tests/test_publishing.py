"""The list of digests, the cache of page batches, links."""

import hashlib
import json
import re

from loomspan.functions import text as tx
from loomspan.operators import index_page, page_cache


def test_page_batches(spark):
    docs = spark.createDataFrame([(1, 45), (2, 0), (3, None), (4, 20)], "doc_id long, pages int")
    wanted = page_cache.batches(docs)
    assert sorted(map(tuple, wanted.collect())) == [(1, 0, 20), (1, 20, 40), (1, 40, 45), (4, 0, 20)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(1, 0, 20, "a", sha("a"), None), (1, 0, 20, "a", sha("a"), None), (1, 20, 40, "b", "damaged", None), (1, 40, 50, "c", sha("c"), None), (4, 0, 20, " ", sha(" "), None), (4, 0, 20, None, None, None)]
    cache = spark.createDataFrame(rows, "doc_id long, first long, end long, markdown string, sha256 string, empty_policy string")
    planned = page_cache.plan(wanted, cache)
    assert {(r.doc_id, r.first, r.state) for r in planned.select("doc_id", "first", "state").collect()} == {(1, 0, "kept"), (1, 20, "render"), (1, 40, "render"), (4, 0, "render")}
    assert page_cache.assemble(planned).count() == 0
    again = page_cache.record(planned.where("state = 'render'").selectExpr("doc_id", "first", "end", "IF(doc_id = 4, '', concat('p', first)) AS markdown"))
    done = page_cache.assemble(page_cache.plan(wanted, cache.unionByName(again)))
    assert {r.doc_id: r.markdown for r in done.collect()} == {1: "a\n\np20\n\np40", 4: ""}


def test_index_page(spark):
    rows = [("daily", "2021-01-03", "x\n## </script> head\n# b"), ("weekly", "2020-W53", None), ("weekly", "2021-W53", "no such week"), ("monthly", "2021-02", "#"), ("monthly", "2021-13", "t"), ("daily", "2021-1-3", "t"), (None, None, None)]
    found = index_page.items(spark.createDataFrame(rows, "kind string, label string, text string"))
    got = {r.label: (str(r.start), str(r.end), r.title, r.href, r.size) for r in found.collect()}
    assert got == {
        "2021-01-03": ("2021-01-03", "2021-01-03", "</script> head", "daily-2021-01-03.html", 23), "2020-W53": ("2020-12-28", "2021-01-03", "2020-W53", "weekly-2020-W53.html", 0),
        "2021-02": ("2021-02-01", "2021-02-28", "2021-02", "monthly-2021-02.html", 1),
    }
    days = spark.sql("SELECT explode(sequence(date'2021-01-03', date'2021-01-05')) AS day")
    gone = index_page.missing(found, days)
    assert {tuple(r) for r in gone.collect()} == {("daily", "2021-01-04"), ("daily", "2021-01-05"), ("weekly", "2021-W01"), ("monthly", "2021-01")}
    text = index_page.page(index_page.payload(found, gone).first().payload, "A & B")
    data = re.search(r'id="data">(.*?)</script>', text)[1]
    assert len(json.loads(data)["items"]) == 3 and len(json.loads(data)["missing"]) == 4 and "A &amp; B" in text
    assert json.loads(index_page.payload(found.limit(0), gone.limit(0)).first().payload) == {"items": [], "missing": []}


def test_auto_link(spark):
    rows = [("www.a.org http://b.org/x", "[www.a.org](https://www.a.org) [http://b.org/x](http://b.org/x)"), ("(http://a.org) [x](http://b.org)", "(http://a.org) [x](http://b.org)"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r[0] for r in df.select(tx.auto_link(df.t)).collect()] == [w for _, w in rows]
