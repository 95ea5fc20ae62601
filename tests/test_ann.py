"""Approximate vector search against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import ann, retrieval


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_with_a_quarter_of_the_lists(spark, tmp_path, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    root = f"file://{tmp_path}/index"
    ann.build(vectors, root)
    index, facts = ann.load(spark, root)
    n = vectors.count()
    assert spark.read.parquet(f"{root}/vectors").count() == n
    codes = spark.read.parquet(f"{root}/codes")
    assert codes.select("vec_id").distinct().count() == n and codes.count() == facts["spill"] * n  # every row is indexed
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = retrieval.batch_top_k(vectors, queries, 10)
    got = ann.quality(ann.search(spark, root, queries, 10), exact, facts, 10).first()
    print(sf, got, facts)
    assert got.queries == queries.count() and got.recall >= 0.95 and got.share <= 0.25
    every = ann.search(spark, root, queries, 10, probes=facts["lists"], rerank=n)
    assert {(r.query_id, r.vec_id) for r in every.collect()} == {(r.query_id, r.vec_id) for r in exact.collect()}
    assert {r.cell for r in codes.select("cell").distinct().collect()} <= set(index.group_of.tolist())


def test_copies_ties_and_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0] + [0.0] * 5) for i in range(400)]  # copies: ties go to the lesser ids
    rows += [(7, rows[7][1]), (2000, None), (2001, [0.0] * 6), (2002, [1.0]), (2003, [float("nan")] * 6), (None, [1.0] * 6), (2004, [None] * 6)]
    df = spark.createDataFrame([(k, v, 1, 2, 3) for k, v in rows], "vec_id long, embedding array<float>, list int, cell int, code int").repartition(4)
    root = f"file://{tmp_path}/index"
    ann.build(df, root)
    assert spark.read.parquet(f"{root}/vectors").count() == 701
    queries = spark.createDataFrame([(1, [2.0] + [0.0] * 5), (2, rows[7][1]), (3, [0.0] * 6), (4, None), (5, [1.0])], "query_id int, embedding array<double>")
    got = ann.search(spark, root, queries, 5, probes=1000).orderBy("query_id", "rank").collect()
    first = [r.vec_id for r in got if r.query_id == 1]
    assert first == [1000, 1001, 1002, 1003, 1004]
    assert [(r.vec_id, round(r.distance, 6)) for r in got if r.query_id == 2][:2] == [(7, 0.0), (7, 0.0)]
    assert {r.query_id for r in got} == {1, 2}


def test_text_ids_and_no_rows(spark, tmp_path):
    named = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "vec_id string, embedding array<float>")
    queries = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, embedding array<float>")
    ann.build(named, f"file://{tmp_path}/named")
    assert [r.vec_id for r in ann.search(spark, f"file://{tmp_path}/named", queries, 2).orderBy("rank").collect()] == ["a", "b"]
    ann.build(named.limit(0), f"file://{tmp_path}/none")
    none = ann.search(spark, f"file://{tmp_path}/none", queries, 2)
    assert none.count() == 0 and none.columns == ["query_id", "vec_id", "distance", "rank"]
    assert ann.search(spark, f"file://{tmp_path}/named", queries.limit(0), 2).count() == 0


def test_codes_come_near():
    rng = np.random.default_rng(5)
    x = ann._unit(rng.standard_normal((3000, 30)).astype(np.float32))
    groups = ann._means(x, 4)
    index = ann.Index(groups, ann._means(x, 16), np.repeat(np.arange(4), 4), np.zeros((ann.SEGMENTS, 1, 2), np.float32), 1)
    rest = index.padded(x - index.centres[index.assigned(x, 1)[:, 0]])
    index.books = np.stack([ann._filled(ann._means(rest[:, j], ann.CODEWORDS, sphere=False)) for j in range(ann.SEGMENTS)])
    lists = index.assigned(x, 1)[:, 0]
    back = index.decoded(index.codes(x, lists), lists)
    assert ((back - x) ** 2).sum(1).mean() < 0.05 * (x**2).sum(1).mean()
