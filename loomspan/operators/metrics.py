"""Costs, ledgers, throughput and projections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBED_PRICE = 0.01  # for a million tokens
GIB = float(1 << 30)


def ledger_usage(requests: DataFrame) -> DataFrame:
    return requests.agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent"),
        F.coalesce(F.sum(F.when(F.col("cost_usd").isNull(), F.col("reserved_usd"))), F.lit(0.0)).alias("reserved"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("tokens"),
    )


def admit(requests: DataFrame, limit: int) -> DataFrame:
    """(account, seq, amount, admitted): in order of seq, a request is admitted if it fits the account's limit; a refused one takes nothing.

    A null amount is refused. Null accounts are one account; requests of one seq come by amount, a null first. The fold of one account is
    sequential by its meaning; its rows stream through one sorted partition and none is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, spent = object(), 0  # carried from batch to batch: a partition is sorted, no account is gathered
        for batch in batches:
            out = []
            for a, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if a != account:
                    account, spent = a, 0
                out.append(x is not None and spent + x <= limit)
                spent += x if out[-1] else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], ["account", "seq", "amount", "admitted"])

    rows = requests.select("account", "seq", "amount").repartition("account").sortWithinPartitions("account", "seq", "amount")
    return rows.mapInArrow(run, "account long, seq long, amount long, admitted boolean")


def admitted(spent: Column, amount: Column, limit: Column) -> Column:
    """A ledger takes a request that does not lead beyond its limit; nulls are refused."""
    return F.coalesce(spent + amount <= limit, F.lit(False))


def within_budget(total: Column, limit: float | None, strict: bool = False) -> Column:
    """Whether a run may start: its total is at most the limit, or below it if `strict`; no limit admits all."""
    if limit is None:
        return F.lit(True)
    return F.coalesce(total < limit if strict else total <= limit, F.lit(False))


def inventory(files: DataFrame, most: int = 100 * 1000 * 1000) -> DataFrame:
    """One row (files, bytes, gib, oversized): how many, how large, and the paths beyond the limit in order."""
    large = F.array_sort(F.collect_list(F.when(F.col("size") > most, F.col("path"))))
    out = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), large.alias("oversized"))
    return out.select("files", "bytes", (F.col("bytes") / GIB).alias("gib"), "oversized")


def storage_cost(size: Column, days: int, searches: int, index_gib: Column | None = None) -> Column:
    """Files, index (as large as the files unless its GiB are given) and searches at the published rates, for a size in bytes."""
    return size / GIB * 0.025 * days + (size / GIB if index_gib is None else index_gib) * 0.10 * days + F.lit(searches * 0.0025)


def eta_hours(remaining: Column, per_hour: Column) -> Column:
    """Hours until nothing remains; null where nothing does or nothing moves."""
    return F.when((remaining > 0) & (per_hour > 0), remaining / per_hour)


def run_rate(ready: Column, ready_at_start: Column, elapsed: Column) -> Column:
    """Papers an hour since the run began; 0 in its first minute."""
    return F.when(elapsed >= 60, F.greatest(F.lit(0), ready - ready_at_start) / elapsed * 3600.0).otherwise(0.0)


def run_status(indexed: DataFrame, ready_markdown: Column, ready_at_start: Column, elapsed: Column, skip_error: str) -> DataFrame:
    """One row of a run: counts by state, stored chunks, known skips, rate and ETA of the backlog without them. indexed: state, error, next_chunk."""
    counts = indexed.agg(
        F.count_if(F.col("state") == "ready").alias("ready"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "indexing").alias("indexing"),
        F.coalesce(F.sum("next_chunk"), F.lit(0)).alias("chunks"), F.count_if((F.col("state") == "failed") & (F.col("error") == skip_error)).alias("skipped"),
    )
    rate = run_rate(F.col("ready"), ready_at_start, elapsed)
    backlog = F.greatest(F.lit(0), ready_markdown - F.col("ready") - F.col("skipped"))
    return counts.select("*", (F.col("failed") - F.col("skipped")).alias("retryable"), rate.alias("per_hour"), F.when(rate > 0, backlog / rate).alias("eta_hours"))


def extrapolation(done: DataFrame, total: DataFrame) -> DataFrame:
    """One row (per_paper, by_bytes, low, high): what the whole would come to, by the mean of a paper and by the ratio of bytes; all rounded up.

    done: size (of the result), source_size; total: size of every source. Null without results.
    """
    d = done.agg(F.count("*").alias("n"), F.sum("size").alias("out"), F.sum("source_size").alias("source"))
    t = total.agg(F.count("*").alias("all_n"), F.coalesce(F.sum("size"), F.lit(0)).alias("all_bytes"))
    both = d.crossJoin(t)  # one row each
    mean = F.when(F.col("n") > 0, F.ceil(F.col("out") / F.col("n") * F.col("all_n")))
    ratio = F.when(F.col("n") > 0, F.when(F.col("source") > 0, F.ceil(F.col("out") / F.col("source") * F.col("all_bytes"))).otherwise(F.lit(0)))
    out = both.select(mean.cast("long").alias("per_paper"), ratio.cast("long").alias("by_bytes"))
    return out.select("per_paper", "by_bytes", F.least("per_paper", "by_bytes").alias("low"), F.greatest("per_paper", "by_bytes").alias("high"))


def chunk_eta(sources: DataFrame, measured: DataFrame, skipped: DataFrame, stored: int, stored_at_start: int, elapsed: float) -> DataFrame:
    """One row (remaining, per_hour, eta_hours, caveat): chunks to go by an earlier measurement, if that still has the same scope.

    sources: path, size; skipped: path of the sources that the measurement left out;
    measured: one row with papers, bytes, chunks. Where the skipped are no sources, or
    the rest differs in number or bytes, only the caveat is set.
    """
    out = skipped.select("path").distinct().withColumn("__out", F.lit(True))
    both = sources.join(out, "path", "full")
    now = both.agg(
        F.count_if(F.col("__out").isNull()).alias("papers_now"), F.coalesce(F.sum(F.when(F.col("__out").isNull(), F.col("size"))), F.lit(0)).alias("bytes_now"),
        F.count_if(F.col("__out") & F.col("size").isNull()).alias("strange"),
    )
    both = now.crossJoin(measured)  # one row each
    fits = (F.col("strange") == 0) & (F.col("papers_now") == F.col("papers")) & (F.col("bytes_now") == F.col("bytes"))
    rate = F.lit(max(0, stored - stored_at_start) / elapsed * 3600.0 if elapsed >= 60 else 0.0)
    remaining = F.greatest(F.lit(0), F.col("chunks") - stored)
    return both.select(
        F.when(fits, remaining).alias("remaining"), F.when(fits, rate).alias("per_hour"), F.when(fits & (rate > 0), remaining / rate).alias("eta_hours"),
        F.when(fits, "measured").otherwise("stale").alias("caveat"),
    )


def failure_counts(results: DataFrame) -> DataFrame:
    """(kind, n): results by kind, all that begin with `error` as one."""
    kind = F.when(F.lower("result").startswith("error"), "error").otherwise(F.coalesce("result", F.lit("")))
    return results.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def link_counts(links: DataFrame) -> DataFrame:
    """One row (papers, pdfs, failed, ok, text_tokens) of fetched links (url, kind, error, scholarly, tokens).

    A scholarly PDF counts as paper and as PDF; what was skipped or is binary counts nowhere.
    """
    read = ~F.coalesce(F.col("kind").isin("skipped", "binary"), F.lit(False))
    pdf, failed = F.col("kind") == "pdf", F.col("error").isNotNull()
    return links.where(read).agg(
        F.count_if(F.col("scholarly")).alias("papers"), F.count_if(pdf).alias("pdfs"), F.count_if(failed).alias("failed"),
        F.count_if(~failed & ~pdf).alias("ok"), F.coalesce(F.sum(F.when(~failed & ~pdf, F.col("tokens"))), F.lit(0)).alias("text_tokens"),
    )


def rebuild_states() -> Column:
    """Whether a digest (text, forced, fresh) is unusable, forced, stale or reused."""
    return F.when(F.length(F.trim("text")) < 50, "unusable").when(F.coalesce("forced", F.lit(False)), "forced").when(F.coalesce("fresh", F.lit(False)), "reused").otherwise("stale")


def throughput(rows: DataFrame, now: Column, started: Column, minutes: tuple[int, ...] = (5, 15, 60, 120)) -> DataFrame:
    """(minutes, attempts, per_hour) over trailing windows that never begin before the run. rows: state, updated (seconds)."""
    wide = rows.select("state", "updated", F.explode(F.array(*map(F.lit, minutes))).alias("minutes"), now.alias("now"), started.alias("started"))
    cutoff = F.greatest(F.col("now") - 60 * F.col("minutes"), F.col("started"))
    out = wide.groupBy("minutes").agg(F.count_if((F.col("updated") > cutoff) & F.col("state").isin("ready", "failed")).alias("attempts"), F.first(F.col("now") - cutoff).alias("elapsed"))
    return out.select("minutes", "attempts", F.when(F.col("elapsed") < 60, 0.0).otherwise(F.col("attempts") * 3600.0 / F.col("elapsed")).alias("per_hour"))


def with_eta(rates: DataFrame, sources: int, ready: int, failed_in_run: int) -> DataFrame:
    """Throughput with what remains of this run's first pass, and the hours that it takes at each window's rate."""
    remaining = F.lit(sources - ready - failed_in_run).cast("long")
    return rates.select("*", remaining.alias("remaining"), eta_hours(remaining, F.col("per_hour")).alias("eta_hours"))


def projections(spark, vectors: int, dimensions: tuple[int, ...], prices: tuple[float, ...], tokens: int) -> DataFrame:
    """Grid of dimensions and prices: FP32 GiB, RAM range, cost of embedding."""
    dims = spark.createDataFrame([(d,) for d in dimensions], "dimensions int")
    rates = spark.createDataFrame([(p,) for p in prices], "price double")
    gib = F.lit(vectors).cast("long") * F.col("dimensions") * 4 / GIB  # bytes go beyond an int
    return dims.crossJoin(rates).select("dimensions", "price", gib.alias("fp32_gib"), (2 + 2 * gib).alias("ram_gib"), (F.lit(tokens) / 1e6 * F.col("price")).alias("cost_usd"))
