"""Uploads that run: a bounded number at once, each step's outcome known, none sent twice.

Before anything is sent, what is about to be is noted in the manifest, a keyed table. A run
that dies so leaves rows of phase `uploading` without a file, which a plan never sends
again: they have to be reconciled. Each row's steps run in order in one task, and there
are as many tasks as may send at once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.operators import uploads
from loomspan.sources import keyed

MANIFEST = "path string, sha256 string, size_bytes long, file_id string, phase string, error string"
AT_ONCE, TRIES, POLLS = 8, 3, 20


class Busy(OSError):
    """The other side asks to come again; nothing was done."""


class Refused(OSError):
    """The other side will not do it; nothing was done."""


class Unknown(OSError):
    """No answer: whether it was done is not known."""


class Side(Protocol):
    """A hosted collection. Any call may raise Busy, Refused or Unknown."""

    def upload(self, path: str, content: bytes) -> str: ...

    def attach(self, file_id: str, path: str) -> None: ...

    def update(self, file_id: str, path: str, content: bytes) -> None: ...

    def reindex(self, file_id: str) -> None: ...

    def poll(self, file_id: str) -> str:
        """ready, processing or failed."""


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return keyed.read(spark, root, MANIFEST)


def _again(call: Callable, tries: int, wait: float):
    """The call's result; one that is told to come again does, later each time."""
    for turn in range(tries):
        try:
            return call()
        except Busy:
            if turn + 1 == tries:
                raise
            time.sleep(wait * 2**turn)


def steps_of(side: Side, path: str, content: bytes, file_id: str | None, steps: list[str], tries: int, wait: float, polls: int) -> tuple[str | None, str, str | None, bool]:
    """(file_id, phase, error, mutated) after a row's steps; the first that fails ends them."""
    phase, mutated, step = "uploading" if file_id is None else "uploaded", False, ""
    try:
        for step in steps:
            if step == "upload":
                file_id = _again(lambda: side.upload(path, content), tries, wait)
                phase, mutated = "uploaded", True
            elif step == "attach":
                _again(lambda: side.attach(file_id, path), tries, wait)
                phase, mutated = "attached", True
            elif step == "update":
                phase = "updating"
                _again(lambda: side.update(file_id, path, content), tries, wait)
                mutated = True
            elif step == "reindex":
                _again(lambda: side.reindex(file_id), tries, wait)
                phase, mutated = "attached", True
            else:
                for turn in range(polls):
                    state = _again(lambda: side.poll(file_id), tries, wait)
                    if state != "processing":
                        return file_id, state, None if state == "ready" else "processing failed", mutated
                    if turn + 1 < polls:
                        time.sleep(wait)
                return file_id, phase, "not ready in time", mutated
    except (Busy, Refused) as error:
        kept = "new" if file_id is None else phase if step in ("attach", "update") else "failed"  # what is still to be done is done next time
        return file_id, kept, f"{type(error).__name__}: {error}", mutated
    except OSError as error:  # also Unknown: an upload stays as it was noted, for someone to look
        return file_id, phase, f"{type(error).__name__}: {error}", mutated or file_id is not None
    return file_id, phase, None, mutated


def run(inputs: DataFrame, root: str, connect: Callable[[], Side], at_once: int = AT_ONCE, tries: int = TRIES, wait: float = 1.0, polls: int = POLLS, retry_failed: bool = False) -> DataFrame:
    """(path, action, phase, error) of every input after a run that sends what the plan says, at most `at_once` at a time.

    inputs: path, sha256, size_bytes, blank, content, a row for each path. `connect` makes
    a side in each task. Rows that are not sent have their action and the phase that the
    manifest has.
    """
    spark = inputs.sparkSession
    held = manifest(spark, root)
    planned = scratch.materialize(uploads.plan(inputs.select("path", "sha256", "size_bytes", "blank"), held, retry_failed), "upload-plan")
    todo = planned.where("action = 'send'").select("path", "steps")
    told = inputs.select("path", "sha256", F.col("size_bytes").cast("long").alias("size_bytes"), "content").join(todo, "path").join(held.select("path", F.col("file_id")), "path", "left")
    begun = told.where("file_id IS NULL").select("path", "sha256", "size_bytes", F.lit(None).cast("string").alias("file_id"), F.lit("uploading").alias("phase"), F.lit(None).cast("string").alias("error"))
    begun = scratch.materialize(begun, "begun")
    if begun.take(1):
        keyed.upsert(begun, root, ["path"])
    names = ["path", "sha256", "size_bytes", "file_id", "phase", "error", "mutated"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = None
        for batch in batches:
            for path, sha256, size, content, steps, file_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                side = side or connect()
                after = steps_of(side, path, content or b"", file_id, steps.split(","), tries, wait, polls)
                row = (path, sha256, size, *after)
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    rows = told.select("path", "sha256", "size_bytes", "content", "steps", "file_id").repartition(at_once, F.xxhash64("path"))
    outcomes = scratch.materialize(rows.mapInArrow(send, MANIFEST + ", mutated boolean"), "outcomes")
    before = held.where("phase IS NOT NULL").join(outcomes.select("path"), "path", "left_semi").select("path", "sha256", "size_bytes", "file_id", "phase", "error")
    settled = uploads.settle(before, outcomes)
    # what was refused before it began is new again, so it has no row
    keyed.upsert(scratch.materialize(settled, "settled"), root, ["path"], deleted=F.col("phase") == "new")
    now = manifest(spark, root).select("path", "phase", "error")
    refused = outcomes.where("phase = 'new'").select("path", F.col("error").alias("__error"))
    both = planned.select("path", "action").join(now, "path", "left").join(refused, "path", "left")
    return both.select("path", "action", F.coalesce("phase", F.lit("new")).alias("phase"), F.coalesce("__error", "error").alias("error"))
