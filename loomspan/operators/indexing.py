"""Incremental index of papers: passages with character offsets, revisions, durable runs.

A run appends its passages under a name that nothing has used and then commits a manifest
that names, for each paper, the revision and the run that hold it. Passages that no
manifest row names are never read, so a run that dies half way leaves nothing visible, a
run that is repeated finds its papers done, and a changed paper costs only its own passages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.adapters.models import Embedder, embed
from loomspan.functions import tokens
from loomspan.functions.text import revision, unreadable
from loomspan.operators.chunking import tiles
from loomspan.sources import sinks

TOKEN = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0b\f\r]")
ROWS = 1000
Spans = Callable[[str], list[tuple[int, int]]]
MANIFEST = "paper string, revision string, run string, total long, state string, error string"
PASSAGES = "paper string, revision string, chunk long, char_start long, char_end long, document string"


def word_spans(text: str) -> list[tuple[int, int]]:
    """[start, end) of words and marks, the default tokens."""
    return [m.span() for m in TOKEN.finditer(text)]


def offsets(text: str, size: int, overlap: int, spans: Spans = word_spans) -> Iterator[tuple[int, int]]:
    """[start, end) in characters of windows of `size` tokens that share `overlap` with the one before; the last ends with the text's last token, blank ones are left out."""
    for _, _, a, b in tokens.windows(text, spans(text), size, overlap):
        yield a, b


def passages(papers: DataFrame, size: int = 175, overlap: int = 20, spans: Spans = word_spans) -> DataFrame:
    """(paper, revision, chunk, char_start, char_end, document) of papers (paper, revision, text); a text without tokens has none.

    `spans` tells where a text's tokens stand: words and marks, or those of a vocabulary, as `tokens.tokenizer_for(path).spans`, made in the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["paper", "revision", "chunk", "char_start", "char_end", "document"]
        for batch in tiles(batches, 64):  # texts become Python strings a few at a time
            held: list[tuple] = []
            for paper, rev, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, (a, b) in enumerate(offsets(text or "", size, overlap, spans)):
                    held.append((paper, rev, n, a, b, text[a:b]))
                    if len(held) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)
                        held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)

    return papers.select("paper", "revision", "text").mapInArrow(run, PASSAGES)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    found = sinks.current_table(spark, f"{root}/manifest")
    return spark.createDataFrame([], MANIFEST) if found is None else found


def current_passages(spark: SparkSession, root: str) -> DataFrame:
    """The passages of every paper's current revision, with their vectors; none before the first run."""
    ready = manifest(spark, root).where("state = 'ready' OR (state = 'failed' AND run IS NOT NULL)").select("paper", "revision", "run")
    schema = f"{PASSAGES}, id string, embedding array<float>, run string"
    if not ready.take(1):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/passages").join(ready, ["paper", "revision", "run"], "left_semi")


def index(papers: DataFrame, root: str, model: Embedder, recipe: str = "175/20") -> None:
    """Index the papers (paper, text, sha256) that are new or changed.

    A text whose digest is not the stated one, a damaged text and a text without tokens
    fail; a failed paper keeps the revision that it had. One row for each paper is expected.
    """
    spark, run = papers.sparkSession, uuid.uuid4().hex
    known = manifest(spark, root)
    wanted = papers.select("paper", "text", "sha256", revision(recipe, F.col("sha256")).alias("revision"))
    fresh = wanted.join(known.where("state = 'ready'").select("paper", "revision"), ["paper", "revision"], "left_anti")
    text = F.coalesce("text", F.lit(""))
    problem = F.when(~F.sha2(text.cast("binary"), 256).eqNullSafe(F.col("sha256")), "changed since conversion").when(unreadable(text), "unreadable")
    size, overlap = (int(x) for x in recipe.split("/"))
    good = fresh.where(problem.isNull())
    pieces = passages(good, size, overlap).withColumn("id", F.concat_ws(":", F.sha2(F.col("paper").cast("binary"), 256), "revision", F.col("chunk").cast("string")))
    embedded(pieces, model).write.parquet(f"{root}/passages/run={run}")
    written = spark.read.schema(f"{PASSAGES}, id string, embedding array<float>").parquet(f"{root}/passages/run={run}")
    totals = written.groupBy("paper").agg(F.count("*").alias("__total"))
    done = fresh.select("paper", "revision", problem.alias("__problem")).join(totals, "paper", "left")
    done = done.withColumn("__problem", F.coalesce("__problem", F.when(F.col("__total").isNull(), F.lit("no text to embed"))))
    outcome = done.select("paper", F.col("revision").alias("__revision"), "__total", "__problem", F.lit(True).alias("__new"))
    both = known.join(outcome, "paper", "full")
    new, failed = F.col("__new").isNotNull(), F.col("__problem").isNotNull()
    swap = new & ~failed
    sinks.replace_table(
        both.select(
            "paper", F.when(swap, F.col("__revision")).otherwise(F.col("revision")).alias("revision"), F.when(swap, F.lit(run)).otherwise(F.col("run")).alias("run"),
            F.when(swap, F.col("__total")).otherwise(F.coalesce("total", F.lit(0))).alias("total"), F.when(new, F.when(failed, "failed").otherwise("ready")).otherwise(F.col("state")).alias("state"),
            F.when(new, F.col("__problem")).otherwise(F.col("error")).alias("error"),
        ),
        f"{root}/manifest",
    )


def embedded(pieces: DataFrame, model: Embedder, batch: int = ROWS) -> DataFrame:
    """Passages with their vectors, in one pass: the other columns travel as one key beside the text."""
    kept = F.struct("paper", "revision", "chunk", "char_start", "char_end", "id")
    out = embed(pieces.select(F.to_json(kept).alias("chunk_id"), "document"), model, batch, text="document", carry=True)
    row = F.from_json("chunk_id", "paper string, revision string, chunk long, char_start long, char_end long, id string")
    return out.select(row.alias("r"), "document", "embedding").select("r.paper", "r.revision", "r.chunk", "r.char_start", "r.char_end", "document", "r.id", "embedding")
