"""Conversion of files to text behind a protocol: what is done already is skipped, crashes are tried another way, repairs replace only what they read."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import manifests

RESULT = "path string, sha256 string, status string, error string, text string, text_sha256 string"


class Converter(Protocol):
    """The text of a file; raises ValueError where it has none and ConverterCrash where the converter itself died."""

    def __call__(self, content: bytes) -> str: ...


class ConverterCrash(RuntimeError):
    """The converter died on a file; another one may read it."""


def convert(files: DataFrame, done: DataFrame, converter: Converter, fallback: Converter | None = None) -> DataFrame:
    """(path, sha256, status, error, text, text_sha256) of the files (path, content) that are not done as they are.

    done: path, sha256 of files that were converted. A file is converted in a task; an error
    is data, and after a crash the fallback is asked once. An empty text counts as failed.
    """
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    todo = manifests.pending(hashed, done, ["path", "sha256"]).select("path", "sha256", "content")

    def one(content: bytes) -> tuple[str, str | None, str | None]:
        try:
            try:
                text = converter(content)
            except ConverterCrash:
                if fallback is None:
                    raise
                text = fallback(content)
        except (ValueError, OSError, ConverterCrash) as error:
            return "failed", str(error) or type(error).__name__, None
        return ("ready", None, text) if text.strip() else ("failed", "no text", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sha256", "status", "error", "text", "text_sha256"]
        for batch in batches:
            for i, content in enumerate(batch.column(2).to_pylist()):  # a row at a time: texts may be large
                status, error, text = one(content or b"")
                digest = None if text is None else hashlib.sha256(text.encode()).hexdigest()
                given = [batch.column(k).slice(i, 1) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*given, *(pa.array([v], pa.string()) for v in (status, error, text, digest))], names)

    return todo.mapInArrow(run, RESULT)


def repaired(manifest: DataFrame, repairs: DataFrame) -> DataFrame:
    """The manifest (path, text_sha256, text) with the repairs (path, read_sha256, text) that were made of the text that it still has; the others are dropped."""
    new = repairs.select("path", F.col("read_sha256").alias("__read"), F.col("text").alias("__text"))
    both = manifest.join(new, "path", "left")
    fits = F.coalesce(F.col("__read") == F.col("text_sha256"), F.lit(False))
    rest = [c for c in manifest.columns if c not in ("path", "text", "text_sha256")]
    return both.select(
        "path", F.when(fits, F.sha2(F.col("__text").cast("binary"), 256)).otherwise(F.col("text_sha256")).alias("text_sha256"), F.when(fits, F.col("__text")).otherwise(F.col("text")).alias("text"), *rest
    )


def update_checkout(clone: Callable[[], None], pull: Callable[[], None], exists: bool) -> str:
    """Bring a checkout up to date: cloned where there is none, else pulled; one that cannot be pulled is used as it is. Gives cloned, pulled or stale."""
    if not exists:
        clone()
        return "cloned"
    try:
        pull()
    except OSError:
        return "stale"
    return "pulled"
