"""Benchmark decontamination: Wu-Manber search for many word windows at once.

Symbols are words. For each window length a shift table over blocks of words skips
positions at which no window can end; where a block ends some window, its suffix
bucket and the hash of the window's first words select the windows that are compared
word by word.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomspan import scratch
from loomspan.llm.text import ALNUM, slices, utf8

WINDOW = 10
BLOCK = 2
#: Words of test texts that one broadcast holds at most; more are searched in several blocks of items.
BLOCK_WORDS = 2_000_000


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of everything beyond ASCII, A-Z as a-z."""
    return text.translate(ALNUM).split() if text else []


def windows_of(words: list[bytes], length: int) -> list[tuple[bytes, ...]]:
    """All windows of `length` consecutive words; a shorter text is one window, an empty one none."""
    if not words:
        return []
    return [tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))]


class WuManber:
    """Windows of one length: shift table, suffix buckets, direct comparison."""

    def __init__(self, windows: dict[tuple[bytes, ...], tuple], length: int, block: int = BLOCK):
        self.m, self.b = length, min(block, length)
        self.skip = length - self.b + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for window, items in windows.items():
            for j in range(self.b, length + 1):
                key = window[j - self.b : j] if self.b > 1 else window[j - 1]
                self.shift[key] = min(self.shift.get(key, self.skip), length - j)
            last = window[-self.b :] if self.b > 1 else window[-1]
            self.bucket.setdefault(last, {}).setdefault(hash(window[: self.b]), []).append((window, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(end, items) for each occurrence, by rising end; the words are words[end - m + 1 : end + 1]."""
        m, b, skip, shift, bucket = self.m, self.b, self.skip, self.shift, self.bucket
        get, n, end = shift.get, len(words), m - 1
        one = b == 1
        while end < n:
            key = words[end] if one else (words[end - 1], words[end]) if b == 2 else tuple(words[end - b + 1 : end + 1])
            by = get(key, skip)
            if by:
                end += by
                continue
            start = end - m + 1
            for window, items in bucket[key].get(hash(tuple(words[start : start + b])), ()):
                if window == tuple(words[start : end + 1]):
                    yield end, items
            end += 1


def build(items: list[tuple], length: int = WINDOW) -> list[WuManber]:
    """A searcher for each window length that occurs among the items."""
    by_length: dict[int, dict] = {}
    for item, text in items:
        for window in windows_of(words_of(text), length):
            by_length.setdefault(len(window), {}).setdefault(window, set()).add(item)
    return [WuManber({w: tuple(s) for w, s in windows.items()}, m) for m, windows in sorted(by_length.items())]


def scan(words: list[bytes], searchers: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Merged [start, end) spans of hit words, and the items whose windows occur."""
    spans: list[tuple[int, int]] = []
    found: set = set()
    for s in searchers:
        for end, items in s.search(words):
            found.update(items)
            start = end - s.m + 1
            if spans and start <= spans[-1][1] and start >= spans[-1][0]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], end + 1))
            else:
                spans.append((start, end + 1))
    spans.sort()
    merged: list[tuple[int, int]] = []
    for start, end in spans:
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    return merged, found


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The test items in blocks of at most `most` bytes of text, or one item: a block fits a broadcast, whatever the table's size."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id"), F.col("text").cast("binary").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        text = bytes(row.text)
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


_built: dict[str, list[WuManber]] = {}


def _searchers(name: str, items: list[tuple], length: int) -> list[WuManber]:
    """This worker process's searchers of the block it has at hand; only the last block's are kept."""
    if name not in _built:
        _built.clear()
        _built[name] = build(items, length)
    return _built[name]


def find_windows(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, block_bytes: int = 8 * BLOCK_WORDS, whole_rows: bool = False) -> DataFrame:
    """Each document with its number of words, merged spans of hit words, and occurring items.

    Columns: doc_id, n_words, spans (word positions, end exclusive), items (of the
    benchmark's type, in its order); with `whole_rows` also `row`, a struct of all the document's columns.
    A null or empty text has no words. Rows repeat as they come in; extra
    columns are left out. Test items without words, or null, match nothing; items with
    a null id are ignored; equal windows belong to all their items. An empty benchmark
    leaves all documents without hits. Documents are only mapped, never shuffled; a
    benchmark beyond one broadcast is searched block by block, each over the result
    of the one before, and the driver holds two blocks at most.
    """
    spark = docs.sparkSession
    given = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "text")}
    state = docs.select("doc_id", "text")
    if whole_rows:
        state = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        given["row"] = state.schema["row"].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType
    kinds = f"n_words long, spans array<struct<start:long,end:long>>, items array<{item.simpleString()}>"
    fields = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(to_arrow_type(item)))]

    def mapper(block: list[tuple], passed: bool, keep: list[str]):
        handle, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searchers = _searchers(name, handle.value, length)
            for batch in slices(batches):
                rows = []
                before = batch.column("items").to_pylist() if passed else None
                old = batch.column("spans").to_pylist() if passed else None
                for i, t in enumerate(utf8(batch.column("text"))):
                    words = words_of(t)
                    spans, found = scan(words, searchers)
                    if passed:
                        found.update(before[i])
                        spans = _union(spans, [(x["start"], x["end"]) for x in old[i]])
                    rows.append((len(words), [{"start": a, "end": b} for a, b in spans], sorted(found)))
                columns = [pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *(n for n, _ in fields)])

        return run

    blocks = _blocks(benchmark, block_bytes)
    block, passed = next(blocks, []), False
    while block is not None:
        after = next(blocks, None)
        keep = [c for c in given if c != "text" or after is not None]
        state = state.mapInArrow(mapper(block, passed, keep), ", ".join([*(f"{c} {given[c]}" for c in keep), kinds]))
        if after is not None:
            state = scratch.materialize(state, "windows")
        block, passed = after, True
    return state


def without_windows(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """The rows of the documents in which no window of a test item occurs, each as often as it comes, with their own columns."""
    return find_windows(docs, benchmark, length, whole_rows=True).where(F.size("spans") == 0).select("row.*")


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans and items."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def items_sha256(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def hits_sql(documents: str = "documents") -> str:
    """SQL for the contract's rows over a table or subquery of documents."""
    return rf"""
    WITH d0 AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM {documents}),
    i0 AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark WHERE item_id IS NOT NULL),
    wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i0 WHERE len(w) > 0)),
    lens AS (SELECT DISTINCT m FROM wins),
    grams AS (SELECT r, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS g
        FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d0, lens WHERE len(w) >= m)),
    found AS (SELECT r, grams.m AS m, p, item_id FROM grams JOIN wins ON grams.g = wins.g AND grams.m = wins.m),
    hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT r, p, m FROM found)) GROUP BY r),
    its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d0 LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""


SQL = {"op1_decontaminate": hits_sql()}
QUERIES = {"op1_decontaminate": op1_decontaminate}
