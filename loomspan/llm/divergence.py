"""How far the sources of a language diverge, by sort-based streaming.

Tasks count terms per (lang, term, source) over the documents they read, each document
in one block, so what is shuffled is already summed. Sorted by (term, lang, source,
block), a scan of run lengths sums the blocks of each (lang, term, source), which no
source or word can make hot: a key has a row per block at most. A second secondary sort
by (term, lang, source) lets a scan of run lengths close each term: its document
frequency decides whether the language keeps it, and its run, one row with a count per
source, is all that the comparison needs. That is a map over runs: each task sums the
pairs of sources over its runs and keeps the best terms of its groups.

Probabilities are integers: p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)).
"""

from __future__ import annotations

import functools
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.llm.text import LOWER, UPPER, slices, utf8

LEAST, TOP = 10, 10
#: Letters and everything beyond ASCII stay, A-Z as a-z; all other bytes part terms.
TERMS = bytes(LOWER[UPPER.index(c)] if c in UPPER else c if c >= 0x80 or c in LOWER else 0x20 for c in range(256))
#: The order of sorted runs. Spark compares the first bytes of the first column without looking at rows, and terms differ there as languages do not.
SORTED = ["term", "lang", "source"]
#: Entries that a task's counts may hold before they are sent.
ENTRIES = 250_000
#: Cells of the table of probabilities that a task fills at once; sources compared at once; sums of pairs that a task holds.
CELLS, BLOCK, PAIRS = 1 << 19, 256, 1 << 22


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, source, block, documents, occurrences) of blocks of documents.

    A row of `docs` is a document, repeated or not; null columns count as empty.
    """
    given = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    names = ["lang", "term", "source", "block", "documents", "occurrences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        block = TaskContext.get().partitionId() << 24

        def send() -> Iterator[pa.RecordBatch]:
            for (lang, source), (documents, occurrences) in held.items():
                terms = list(documents)
                for i in range(0, len(terms), 50_000):
                    some = terms[i : i + 50_000]
                    n = len(some)
                    columns = [pa.array([lang] * n), pa.array(some, pa.binary()).cast(pa.string()), pa.array([source] * n), pa.array(np.full(n, block, np.int64))]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[t] for t in some], pa.int64()) for c in (documents, occurrences))], names)
            held.clear()

        entries = 0
        for batch in slices(batches):
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, utf8(batch.column(2)), strict=True):
                if words := text.translate(TERMS).split():
                    documents, occurrences = held.get((lang, source)) or held.setdefault((lang, source), (Counter(), Counter()))
                    entries -= len(documents)
                    occurrences.update(words)
                    documents.update(set(words))
                    entries += len(documents)
                    if entries >= ENTRIES:
                        yield from send()
                        block, entries = block + 1, 0
        yield from send()

    return given.mapInArrow(run, "lang string, term string, source string, block long, documents long, occurrences long")


def _starts(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; the first row always does."""
    differs = np.zeros(batch.num_rows, bool)
    differs[:1] = True
    for name in names:
        column = batch.column(name)
        differs[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a run of equal keys ends, with the starts of their runs."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, names)
        if held and all(held[-1].column(n)[-1] == batch.column(n)[0] for n in names) and len(starts) == 1:
            held.append(batch)  # one run, still open
            continue
        cut = int(starts[-1])
        if held or cut:
            whole = joined([*held, batch.slice(0, cut)] if cut else held)
            yield whole, _starts(whole, names)
        held = [batch.slice(cut)]
    if held:
        whole = joined(held)
        yield whole, _starts(whole, names)


def summed_blocks(counts: DataFrame) -> DataFrame:
    """(lang, term, source, documents, occurrences): blocks of a key summed along sorted runs.

    A run may be longer than memory should hold, so its sums alone are carried on.
    """
    keys = ["lang", "term", "source"]
    dealt = counts.repartition(*keys).sortWithinPartitions(*SORTED, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, keys)
            sums = [np.add.reduceat(batch.column(c).to_numpy(), starts) for c in ("documents", "occurrences")]
            heads = batch.take(pa.array(starts))
            got = pa.RecordBatch.from_arrays([*(heads.column(k) for k in keys), *map(pa.array, sums)], [*keys, "documents", "occurrences"])
            if open_run is not None:
                if all(open_run.column(k)[0] == got.column(k)[0] for k in keys):
                    more = [np.concatenate(([x[0] + open_run.column(c)[0].as_py()], x[1:])) for x, c in zip(sums, ("documents", "occurrences"), strict=True)]
                    got = pa.RecordBatch.from_arrays([*(got.column(k) for k in keys), *map(pa.array, more)], got.schema.names)
                else:
                    yield open_run
            if got.num_rows > 1:
                yield got.slice(0, got.num_rows - 1)
            open_run = got.slice(got.num_rows - 1)
        if open_run is not None:
            yield open_run

    return dealt.mapInArrow(run, "lang string, term string, source string, documents long, occurrences long")


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, sources, counts) of the terms in at least `least` documents of their language."""
    keys = ["lang", "term"]
    dealt = summed_blocks(term_counts(docs)).repartition(*keys).sortWithinPartitions(*SORTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _runs(batches, keys):
            frequency = np.add.reduceat(batch.column("documents").to_numpy(), starts)
            ends = np.append(starts[1:], batch.num_rows)
            keep = frequency >= least
            if not keep.any():
                continue
            sizes = (ends - starts)[keep]
            rows = np.repeat(starts[keep] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            heads, members = batch.take(pa.array(starts[keep])), batch.take(pa.array(rows))
            lists = [pa.ListArray.from_arrays(offsets, members.column(c)) for c in ("source", "occurrences")]
            yield pa.RecordBatch.from_arrays([heads.column("lang"), heads.column("term"), *lists], ["lang", "term", "sources", "counts"])

    return dealt.mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>")


def shares(counts: np.ndarray, totals: np.ndarray, size: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * size)), three decimal places at a time so that nothing overflows."""
    under = totals + 2 * size
    rest = counts + 2
    out = np.zeros(np.broadcast(rest, under).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // under
        rest = rest - digit * under
        out = out * 1000 + digit
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    d = p - q
    return d * d // (p + q)


def _compared(kept: DataFrame, shared: Broadcast, top: int, low: int, high: int) -> DataFrame:
    """Each task's partial pairs of the sources numbered `low` to `high` with those after them, from whole runs; from 0 on also its best terms.

    `shared` holds for each language with kept terms its sources in order, their totals
    and the number of kept terms.
    """
    fields = "lang string, source string, part string, item string, value long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {lang: {s: i for i, s in enumerate(sources)} for lang, (sources, _, _) in shared.value.items()}
        pairs: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], list] = {}

        def take(lang: str, terms: list[str], columns: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> None:
            sources, totals, size = shared.value[lang]
            n = len(sources)
            table = np.zeros((len(terms), n), np.int64)
            table[rows, columns] = counts
            whole = shares(table.sum(1), totals.sum(), size)
            p = shares(table, totals[None, :], size)
            if lang not in pairs:
                pairs[lang] = np.zeros((max(0, min(high, n - 1) - low), n), np.int64)
            sums = pairs[lang]
            for i in range(low, low + len(sums)):
                for j in range(i + 1, n, BLOCK):
                    sums[i - low, j : j + BLOCK] += gap(p[:, i : i + 1], p[:, j : j + BLOCK]).sum(0)
            if low:
                return
            over = (table > 0) & (p > whole[:, None])
            values = gap(p, whole[:, None])
            for i in range(n):
                at = np.flatnonzero(over[:, i])
                if len(at) > top:  # ties at the edge stay
                    edge = np.partition(values[at, i], len(at) - top)[len(at) - top]
                    at = at[values[at, i] >= edge]
                if len(at):
                    found = best.get((lang, i), []) + [(-int(values[t, i]), terms[t]) for t in at]
                    best[lang, i] = heapq.nsmallest(top, found)

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                n = len(places[lang])
                mine = np.flatnonzero(langs == lang)
                step = max(1, CELLS // n)
                for start in range(0, len(mine), step):
                    some = batch.take(pa.array(mine[start : start + step]))
                    sizes = pc.list_value_length(some.column(2)).to_numpy()
                    columns = np.array([places[lang][s] for s in some.column(2).flatten().to_pylist()], np.int64)
                    take(lang, some.column(1).to_pylist(), columns, np.repeat(np.arange(len(sizes)), sizes), some.column(3).flatten().to_numpy())
        for lang, sums in pairs.items():
            sources = shared.value[lang][0]
            for i in range(low, low + len(sums)):
                rest = sources[i + 1 :]
                n = len(rest)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([sources[i]] * n), pa.array(["pair"] * n), pa.array(rest), pa.array(sums[i - low, i + 1 :])], ["lang", "source", "part", "item", "value"])
        rows = [(lang, shared.value[lang][0][i], "term", term, -value) for (lang, i), found in best.items() for value, term in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "source", "part", "item", "value"])

    return kept.mapInArrow(run, fields)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources of a language, and each source's most divergent terms.

    Null lang, source and text count as empty. A group without terms, or of a language
    without kept terms, still has its pairs; a language of one source has none. Repeated
    rows count as often as they come, doc_id is not read, other columns are left out, and
    an empty table gives no rows. Ties rank by the item's UTF-8 bytes.

    The driver and the tasks hold the sources of languages with kept terms, a number
    each; the result has a row for every pair of them.
    """
    spark = docs.sparkSession
    names = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).groupBy("lang", "source").agg(F.count("*").alias("n"))
    names = scratch.materialize(names.drop("n"), "groups")
    kept = scratch.materialize(kept_terms(docs, least), "runs")
    sizes = {r.lang: r.n for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    totals = {(r.lang, r.source): r.n for r in each.groupBy("lang", "source").agg(F.sum("n").alias("n")).collect()}
    of_lang: dict[str, list[str]] = {}
    if sizes:
        spoken = spark.createDataFrame([(x,) for x in sizes], "lang string")
        for r in names.join(spoken, "lang", "left_semi").collect():
            of_lang.setdefault(r.lang, []).append(r.source)
    groups = {lang: (sorted(s), np.array([totals.get((lang, x), 0) for x in sorted(s)], np.int64), sizes[lang]) for lang, s in of_lang.items()}
    shared = spark.sparkContext.broadcast(groups)
    most = max((len(s) for s, _, _ in groups.values()), default=1)
    step = max(1, PAIRS // most)  # where a task cannot hold the sums of all pairs, the runs are scanned again for the next sources
    scans = [_compared(kept, shared, top, low, low + step) for low in range(0, most, step)]
    partial = scratch.materialize(functools.reduce(DataFrame.unionByName, scans), "partial")
    sums = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = names.join(names.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    found = pairs.unionByName(partial.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {
    "op13_source_divergence": r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
    v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY t.lang, source, t.term),
    gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
    full_counts AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, coalesce(gn.total, 0) AS total, v.v,
            1 + CAST(kept.n + 2 AS HUGEINT) * 1000000000 // (v.total + 2 * v.v) AS q
        FROM g JOIN kept ON g.lang = kept.lang JOIN v ON g.lang = v.lang
        LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND kept.term = c.term LEFT JOIN gn ON g.lang = gn.lang AND g.source = gn.source),
    p AS (SELECT lang, source, term, n, q, 1 + CAST(n + 2 AS HUGEINT) * 1000000000 // (total + 2 * v) AS p FROM full_counts),
    pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
}
QUERIES = {"op13_source_divergence": op13_source_divergence}
