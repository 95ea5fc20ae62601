"""Conversion of long documents by batches of pages, under deadlines, with the finished batches kept.

A run renders the batches that are missing, in order, each document in one task, until
its deadline; what it has is appended to the cache, and the next run goes on from there.
A document is whole when all of its batches are.
"""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.operators import page_cache
from loomspan.sources import sinks

CACHE = "doc_id string, first long, end long, markdown string, sha256 string, empty_policy string"

#: The Markdown of pages [first, end) of a file; raises ValueError or OSError where it cannot be read.
Renderer = Callable[[bytes, int, int], str]


@contextmanager
def within(seconds: float):
    """Raise TimeoutError in what runs longer. Tasks run Python in a worker's main thread, where alarms arrive."""

    def ring(*_):
        raise TimeoutError(f"longer than {seconds:g} s")

    old = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, max(seconds, 1e-3))
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def cache(spark: SparkSession, root: str) -> DataFrame:
    """The batches that are kept, damaged ones too; none before the first run."""
    return spark.read.schema(CACHE).parquet(f"{root}/batches") if sinks.names(spark, f"{root}/batches") else spark.createDataFrame([], CACHE)


def convert(documents: DataFrame, root: str, render: Renderer, deadline: float = 600.0, size: int = page_cache.PAGES) -> DataFrame:
    """(doc_id, state, markdown, batches, kept, error) of every document (doc_id, pages, content): ready, failed, or unfinished at the deadline.

    doc_id names a document and its content's revision, so a changed file is another
    document. `deadline` is in seconds for each document and run; a batch that is being
    rendered then is given up. After an error the document's other batches are not tried.
    Documents without pages fail. One row for each id is expected; of repeated ones any counts.
    """
    spark = documents.sparkSession
    given = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("pages").cast("long").alias("pages"), "content")
    wanted = page_cache.batches(given, size)
    planned = page_cache.plan(wanted, cache(spark, root))
    open_ranges = planned.where("state = 'render'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("ranges"))  # a row for PAGES pages
    names = ["doc_id", "first", "end", "markdown", "error"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                began = time.monotonic()
                for r in ranges:
                    markdown = error = None
                    left = deadline - (time.monotonic() - began)
                    try:
                        if left <= 0:
                            raise TimeoutError("the deadline has passed")
                        with within(left):
                            markdown = render(content or b"", r["first"], r["end"])
                    except TimeoutError as late:
                        error = f"deadline: {late}"
                    except (ValueError, OSError) as problem:
                        error = str(problem) or type(problem).__name__
                    row = (doc_id, r["first"], r["end"], markdown, error)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)
                    if error:
                        break

    todo = given.select("doc_id", "content").join(open_ranges, "doc_id")
    rendered = scratch.materialize(todo.mapInArrow(run, "doc_id string, first long, end long, markdown string, error string"), "rendered")
    page_cache.record(rendered).write.mode("append").parquet(f"{root}/batches")
    after = scratch.materialize(page_cache.plan(wanted, cache(spark, root)), "after")
    whole = page_cache.assemble(after)
    errors = rendered.where("error IS NOT NULL").groupBy("doc_id").agg(F.min("error").alias("error"))
    counts = after.groupBy("doc_id").agg(F.count("*").alias("batches"), F.count_if(F.col("state") == "kept").alias("kept"))
    both = given.select("doc_id").join(counts, "doc_id", "left").join(whole, "doc_id", "left").join(errors, "doc_id", "left")
    state = F.when(F.col("batches").isNull(), "failed").when(F.col("markdown").isNotNull(), "ready").when(F.col("error").startswith("deadline"), "unfinished").otherwise("failed")
    problem = F.coalesce("error", F.when(F.col("batches").isNull(), F.lit("no pages")))
    return both.select("doc_id", state.alias("state"), "markdown", F.coalesce("batches", F.lit(0)).alias("batches"), F.coalesce("kept", F.lit(0)).alias("kept"), problem.alias("error"))
