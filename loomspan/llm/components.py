"""Connected components of a distributed list of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least of a node and its neighbours: the larger ones (large) or the smaller ones."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    moved = near.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; a component is named by its least node.

    edges: columns a and b of one type. Self-links and repeated links do no harm. Each
    step is written to the shared folder; the steps end when the links are stars, after
    a number of rounds that grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    at = scratch.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most):
        large = scratch.materialize(_star(at, True), "large")
        small = scratch.materialize(_star(large, False), "small")
        state = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        for old in {*at.inputFiles()[:1], *large.inputFiles()[:1]}:
            scratch.remove(spark, old.rsplit("/", 1)[0])
        at = small
        if before == (state.n, state.s):
            break
        before = (state.n, state.s)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    heads = at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)
