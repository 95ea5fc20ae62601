"""Manifests: what has been done to which content. Anti-joins, upserts, staleness, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose keys (say path and revision) are not done."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins for each key."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def upsert(manifest: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The manifest with the rows of changed keys replaced, repeated ones by all of the changes; null keys equal nothing, so their rows stay and are added."""
    return manifest.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def record_failures(manifest: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """Set state, error and updated of failed keys; revision and offset survive, new keys get nulls.

    Of a key that failed repeatedly its latest failure counts, of equally late ones that
    with the greatest error. Failures without a key or a time are left out.
    """
    f = failures.where(F.col(key).isNotNull() & F.col("updated").isNotNull()).groupBy(key).agg(F.max(F.struct("updated", "error")).alias("__f"))
    both = manifest.join(f.select(key, F.col("__f.error").alias("__error"), F.col("__f.updated").alias("__updated")), key, "full")
    failed = F.col("__updated").isNotNull()
    return both.select(
        key, *(c for c in manifest.columns if c not in (key, "state", "error", "updated")),
        F.when(failed, "failed").otherwise(F.col("state")).alias("state"), F.when(failed, F.col("__error")).otherwise(F.col("error")).alias("error"),
        F.coalesce("__updated", "updated").alias("updated"),
    )


def replace_revision(store: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Drop every stored row of the papers that are indexed anew, then add the new rows."""
    return store.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def stale(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """(key, n_children, stale): a parent is stale if it is missing or older than a child."""
    # a null time of a child counts for nothing, one of a parent as missing; children without a key are a group of their own that has no parent
    newest = children.groupBy(key).agg(F.max("mtime").alias("child_mtime"), F.count("*").alias("n_children"))
    # a parent that is repeated counts by its newest row
    both = newest.join(parents.groupBy(key).agg(F.max("mtime").alias("parent_mtime")), key, "left")
    return both.select(key, "n_children", (F.col("parent_mtime").isNull() | (F.col("child_mtime") > F.col("parent_mtime"))).alias("stale"))


def transfer_state(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, state, bytes): complete, partial, outdated or missing; files that nobody expects are left out.

    A row for each expected row, repeated ones too; `actual` has a key once. A null size
    or time equals nothing, so such a file is outdated, or missing where `actual` has none.
    """
    a = actual.select(key, F.col("size").alias("has"), F.col("mtime").alias("at"), F.lit(True).alias("there"))
    both = expected.join(a, key, "left")
    same = F.coalesce((F.col("size") == F.col("has")) & (F.col("mtime") == F.col("at")), F.lit(False))
    less = F.coalesce(F.col("has") < F.col("size"), F.lit(False))
    state = F.when(F.col("there").isNull(), "missing").when(same, "complete").when(less, "partial").otherwise("outdated")
    return both.select(key, state.alias("state"), F.when(same | less, F.col("has")).otherwise(0).alias("bytes"))


def inventory_problems(expected: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """(key, problem) of expected files that are not there, of another size, or of a size that is not known on either side.

    A row for each expected row and each local row of its key; a null key is nowhere.
    """
    both = expected.join(local.select(key, F.col("size").alias("has"), F.lit(True).alias("there")), key, "left")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("has").isNull() | F.col("size").isNull(), "unknown size").when(F.col("size") != F.col("has"), "size")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def reconcile(waiting: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """(key, file_id) of waiting uploads that exactly one remote file has the name of; null names match nothing, a repeated key counts all its matches."""
    found = waiting.join(remote, "name").groupBy(key).agg(F.count("*").alias("n"), F.min("file_id").alias("file_id"))
    return found.where("n = 1").select(key, "file_id")


def audit(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, expected, found, problem) by key: missing, orphan, out-of-range (null ones too) or duplicate passages, wrong counts.

    One row for each expected key; a null total is that of a key nobody expects. For the passages themselves see `passage_audit`.
    """
    counts = stored.groupBy(key).agg(F.count("*").alias("found"), F.countDistinct("chunk").alias("kinds"), F.max("chunk").alias("top"), F.min("chunk").alias("low"), F.count("chunk").alias("numbered"))
    both = expected.select(key, "total").join(counts, key, "full")
    problem = (
        F.when(F.col("total").isNull(), "orphan").when(F.col("found").isNull() & (F.col("total") > 0), "missing").when((F.col("low") < 0) | (F.col("numbered") < F.col("found")), "out of range")
        .when(F.col("found") > F.col("kinds"), "duplicate").when(F.col("top") >= F.col("total"), "out of range").when(F.coalesce("found", F.lit(0)) != F.col("total"), "count").otherwise("ok")
    )
    return both.select(key, F.coalesce("total", F.lit(0)).cast("long").alias("expected"), F.coalesce("found", F.lit(0)).alias("found"), problem.alias("problem"))


def between(column: Column, first=None, last=None) -> Column:
    """Whether a value lies in a range that includes its ends; an end that is None is open. A null value lies only in the range that is open at both."""
    low = F.lit(True) if first is None else column >= F.lit(first)
    high = F.lit(True) if last is None else column <= F.lit(last)
    return F.coalesce(low & high, F.lit(False))


def in_scope(rows: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """The rows whose key the scope has, each once however often the scope repeats it."""
    return rows.join(scope.select(key), key, "left_semi")


def done_keys(*parts: DataFrame) -> DataFrame:
    """Every key that any of the parts has, once; a null counts as a key."""
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def set_relation(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row (only_one, only_two, is_subset, equal): how many rows each table has that the other lacks, repeated rows counted."""
    names = one.columns
    sides = one.select(*names, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(two.select(*names, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    rest = sides.groupBy(*names).agg((F.sum("__a") - F.sum("__b")).alias("d"))  # one shuffle for both differences
    out = rest.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_one"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_two"))
    return out.select("only_one", "only_two", (F.col("only_one") == 0).alias("is_subset"), ((F.col("only_one") == 0) & (F.col("only_two") == 0)).alias("equal"))


def lookup(matches: DataFrame, documents: DataFrame, key: str, default: str = "filename", name: str = "name") -> DataFrame:
    """Matches with their documents' fields, in as many rows and order as they come; a document's own name stands in for a missing file name.

    documents: one row for each key. A match without a document has null fields.
    """
    fields = [c for c in documents.columns if c not in (key, name, default)]
    wanted = documents.join(matches.select(key).distinct(), key, "left_semi")
    told = wanted.select(key, F.coalesce(default, name).alias(default), *fields)
    return matches.join(told, key, "left")


def zipped(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """(keys, rank, one column for each array): parallel arrays side by side, as far as the shortest goes; null arrays have no rows."""
    shortest = F.least(*(F.size(c) for c in arrays)) if len(arrays) > 1 else F.size(arrays[0])
    cut = F.slice(F.arrays_zip(*arrays), 1, F.greatest(shortest, F.lit(0)))
    out = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in arrays)).select(*keys, F.posexplode(cut).alias("rank", "x"))
    return out.select(*keys, "rank", *(F.col(f"x.{c}").alias(c) for c in arrays))


def prepared(local: DataFrame, conversions: DataFrame, disk: DataFrame, most: int = 100 * 1000 * 1000, verify: bool = True) -> DataFrame:
    """(path, reason): for each local file the first thing that keeps its conversion from being used, null where it is ready.

    local: path, sha256, size; conversions: path, status, error, pdf_sha256, markdown_path,
    markdown_sha256; disk: markdown_path, sha256, size. Without `verify` digests are not compared.
    """
    c = conversions.select("path", "status", "error", "pdf_sha256", "markdown_path", F.col("markdown_sha256").alias("__wanted"), F.lit(True).alias("__known"))
    on_disk = disk.select("markdown_path", F.col("sha256").alias("__md"), F.col("size").alias("__size"))
    both = local.join(c, "path", "left").join(on_disk, "markdown_path", "left")
    changed = ~(F.col("sha256").eqNullSafe(F.col("pdf_sha256")) & F.col("__md").eqNullSafe(F.col("__wanted")))
    reason = (
        F.when(F.col("__known").isNull(), "not converted").when(~F.col("status").eqNullSafe("ready"), F.coalesce(F.when(F.col("error") != "", F.col("error")), F.col("status")))
        .when(F.col("__size").isNull(), "no converted file").when(changed & F.lit(verify), "changed since conversion").when(F.col("__size") > most, "too large")
    )
    return both.select("path", reason.alias("reason"))


def snapshot(audited: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row (papers, problems, stable, consistent, verdict): an audit holds only if the manifest did not move while it ran.

    audited: what `audit` gives; before, after: the manifest's (key, revision) at its two ends.
    """
    moved = set_relation(before.select(key, "revision"), after.select(key, "revision")).select(F.col("equal").alias("stable"))
    found = audited.agg(F.count("*").alias("papers"), F.count_if(F.col("problem") != "ok").alias("problems"))
    both = found.crossJoin(moved)  # one row each
    verdict = F.when(~F.col("stable"), "moved").when(F.col("problems") > 0, "broken").otherwise("ok")
    return both.select("papers", "problems", "stable", (F.col("problems") == 0).alias("consistent"), verdict.alias("verdict"))


def to_publish(outputs: DataFrame, published: DataFrame) -> DataFrame:
    """Outputs (remote, name, sha256, ...) whose content has not been published there yet."""
    return pending(outputs, published, ["remote", "name", "sha256"])


def mark_published(published: DataFrame, sent: DataFrame) -> DataFrame:
    """The publish manifest (remote, name, sha256) after a run."""
    return upsert(published, sent.select("remote", "name", "sha256"), ["remote", "name"])


def any_changed(parts: DataFrame, keys: list[str], changed: str) -> DataFrame:
    """(keys, changed): whether any part of a group changed; a null counts as unchanged."""
    return parts.groupBy(*keys).agg(F.coalesce(F.bool_or(changed), F.lit(False)).alias(changed))


def read_through(wanted: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of the wanted keys against a local store; misses are what a fetcher has to bring."""
    keys = wanted.select(key).distinct()
    return held.join(keys, key, "left_semi"), keys.join(held.select(key), key, "left_anti")


def next_offsets(manifest: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """(key, revision, next_chunk): where a stopped run goes on.

    manifest: key, revision; progress: key, revision, chunk - one row for each chunk that
    was stored. Chunks of another revision count for nothing; the first gap is where the work resumes, so chunks
    stored beyond it are stored again.
    """
    order = Window.partitionBy(key, "revision").orderBy("chunk")
    ranked = progress.select(key, "revision", "chunk").distinct().withColumn("__n", F.row_number().over(order) - 1).where("chunk = __n")
    reached = ranked.groupBy(key, "revision").agg((F.max("chunk") + 1).alias("next_chunk"))
    return manifest.select(key, "revision").join(reached, [key, "revision"], "left").select(key, "revision", F.coalesce("next_chunk", F.lit(0)).cast("long").alias("next_chunk"))
