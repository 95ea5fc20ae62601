"""The upload state machine as two joins: what to do with each input, and what its outcome leaves in the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import manifests

MOST_BYTES = 100 * 1000 * 1000


def plan(inputs: DataFrame, manifest: DataFrame, retry_failed: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, action, steps): one row for each input.

    inputs: path, sha256, size_bytes, blank; manifest: path, sha256, file_id, phase.
    An upload whose outcome is unknown is never sent again: it has to be reconciled by hand.
    Steps run in order: upload, attach, update, reindex, poll.
    """
    was = manifest.select("path", F.col("sha256").alias("__sha"), F.col("file_id").alias("__file"), F.col("phase").alias("__phase"))
    both = inputs.join(was, "path", "left")
    known, phase = F.col("__sha").isNotNull(), F.coalesce("__phase", F.lit("new"))
    changed = known & (F.col("__sha") != F.col("sha256"))
    no_file = F.col("__file").isNull()
    refused = (
        F.when(~F.lower("path").endswith(".md"), "not markdown").when(F.col("size_bytes") > most_bytes, "too large").when(F.col("blank"), "empty")
        .when(known & ~changed & (phase == "ready"), "unchanged").when(no_file & (phase == "uploading"), "reconcile")
    )
    update = changed | (phase == "updating")
    steps = F.concat_ws(
        ",", F.when(no_file, "upload"), F.when(no_file | (phase == "uploaded"), "attach"), F.when(update, "update"),
        F.when(~update & ~no_file & (phase == "failed") & F.lit(retry_failed), "reindex"), F.lit("poll"),
    )
    return both.select("path", F.coalesce(refused, F.lit("send")).alias("action"), F.when(refused.isNull(), steps).otherwise("").alias("steps"))


def settle(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The manifest after a run.

    outcomes: path, sha256, size_bytes, file_id, phase, error, mutated. A failure before
    anything changed on the other side keeps what the manifest said and only notes the error.
    """
    fields = ("sha256", "size_bytes", "file_id", "phase")
    new = outcomes.select("path", *(F.col(c).alias(f"__{c}") for c in fields), F.col("error").alias("__error"), "mutated", F.lit(True).alias("__ran"))
    both = manifest.join(new, "path", "full")
    keep = F.col("__ran").isNull() | (F.col("__error").isNotNull() & ~F.col("mutated") & (F.col("__phase") != "failed") & F.col("phase").isNotNull())
    error = F.when(F.col("__ran").isNull(), F.col("error")).otherwise(F.col("__error"))
    return both.select("path", *(F.when(keep, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in fields), error.alias("error"))


def retained(manifest: DataFrame, inputs: DataFrame) -> DataFrame:
    """(path, size_bytes) of files that were sent and are no longer among the inputs."""
    return manifest.where("file_id IS NOT NULL").join(inputs.select("path").distinct(), "path", "left_anti").select("path", "size_bytes")


#: The gates of an upload, in the order in which they are asked.
GATES = ("arguments", "report", "dry run", "approval", "converted", "inventory", "budget", "keys", "inputs")


def gate(problems: DataFrame, expected: DataFrame, local: DataFrame, cost: float, budget: float | None, approved: bool, dry_run: bool, chunk: int, overlap: int, has_keys: bool = True, report_only: bool = False, inputs: DataFrame | None = None) -> str | None:
    """The first gate that keeps an upload from starting, or None where all are open.

    problems: conversions that are not usable (reason not null); expected, local: path and
    size of what has to be there. A cost that reaches the budget closes it. `report_only` asks for
    the report of costs and no more; `inputs`, where they are given, must hold a row. Later gates cost nothing if an earlier one is shut.
    """
    if not 0 <= overlap < chunk:
        return "arguments"
    if report_only:
        return "report"
    if dry_run:
        return "dry run"
    if not approved:
        return "approval"
    if not problems.where("reason IS NOT NULL").isEmpty():
        return "converted"
    if not manifests.inventory_problems(expected, local, "path").isEmpty():
        return "inventory"
    if budget is not None and cost >= budget:
        return "budget"
    if not has_keys:
        return "keys"
    return "inputs" if inputs is not None and inputs.isEmpty() else None


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row (ok, unchanged, failed, pending, success) of a run's outcomes (action, error): it succeeds if nothing failed or has to be reconciled."""
    out = outcomes.agg(
        F.count_if((F.col("action") == "send") & F.col("error").isNull()).alias("ok"), F.count_if(F.col("action") == "unchanged").alias("unchanged"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("action") == "reconcile").alias("pending"),
    )
    return out.select("*", ((F.col("failed") == 0) & (F.col("pending") == 0)).alias("success"))
