"""Token windows of documents and message chunks of conversations."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomspan.functions import tokens
from loomspan.functions.text import token_count


def window_count(tokens: Column, size: int, overlap: int) -> Column:
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    return F.when(tokens == 0, 0).otherwise(1 + F.ceil(F.greatest(F.lit(0), tokens - size) / (size - overlap))).cast("long")


def submitted_tokens(tokens: Column, billed: Column, size: int, overlap: int) -> Column:
    n = window_count(tokens, size, overlap)
    return F.when(tokens == 0, 0).otherwise(F.ceil(billed * (tokens + (n - 1) * overlap) / tokens) + n).cast("long")


def fixed_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, chunk, first_token, n_tokens, chunk_text) over words separated by spaces; windows end at the last word, blank ones are dropped. A null text has none; repeated rows repeat theirs."""
    step = size - overlap
    words = docs.select("doc_id", F.split("text", " ").alias("w"))
    n = F.size("w")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    # a window is cut before the rows are made, so that no row carries the other words
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("first_token"), F.slice("w", i * step + 1, size).alias("w")))
    rows = words.select("doc_id", F.posexplode(cut).alias("chunk", "x"))
    rows = rows.select("doc_id", "chunk", "x.first_token", F.size("x.w").alias("n_tokens"), F.array_join("x.w", " ").alias("chunk_text"))
    return rows.where(F.length(F.regexp_replace("chunk_text", r"(?U)\s", "")) > 0)


def token_windows(docs: DataFrame, size: int, overlap: int, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, chunk, first_token, n_tokens, char_start, char_end, chunk_text) over the tokens of a vocabulary file.

    A window's text is cut at its tokens' characters, so a character that two windows'
    tokens share is in both. Blank windows are dropped before they are numbered. A null
    text has none, repeated rows repeat theirs, other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "chunk", "first_token", "n_tokens", "char_start", "char_end", "chunk_text"]
    types = [to_arrow_type(kind), pa.int32(), *[pa.int64()] * 4, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.tokenizer_for(path, pattern)
        for batch in batches:
            rows = (
                (key, i, first, n, a, b, text[a:b])
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for i, (first, n, a, b) in enumerate(tokens.windows(text or "", tokenizer.spans(text or ""), size, overlap))
            )
            for some in chunked(rows, 1000):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate(types)], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, chunk int, first_token long, n_tokens long, char_start long, char_end long, chunk_text string")


def open_chunks(messages: Iterator[tuple], most: int, overlap: int) -> Iterator[tuple[int, int, int, list]]:
    """(start, end, tokens, contents) of chunks of (tokens, content) messages: full before a message that does not fit.

    The next chunk begins with the shortest tail of `overlap` tokens, at least one message; only the open chunk is held.
    """
    held: list[tuple] = []
    total = begin = 0
    for i, message in enumerate(messages):
        if held and total + message[0] > most:
            yield begin, i, total, [c for _, c in held]
            back, keep = 0, 0
            while keep < len(held):
                keep += 1
                back += held[-keep][0]
                if back >= overlap:
                    break
            held, total, begin = held[len(held) - keep :], back, i - keep
        held.append(message)
        total += message[0]
    if held:
        yield begin, begin + len(held), total, [c for _, c in held]


def fold(tokens: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of the chunks of messages of so many tokens."""
    return [(a, b) for a, b, _, _ in open_chunks(((n, None) for n in tokens), most, overlap)]


CHUNKS = ["conv_id", "chunk", "first_message", "end_message", "n_tokens", "chunk_text"]


def message_chunks(messages: DataFrame, most: int, overlap: int, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """(conv_id, chunk, first_message, end_message, n_tokens, chunk_text): greedy chunks of each conversation in order of its turns.

    A null text is an empty message; messages of one turn come by their text, a null turn
    first; messages without a conversation are one. `count` counts a text's tokens, by a pattern unless another is given, say `functions.tokens.count`. Conversations stream through sorted
    partitions, of which only the open chunk is held.
    """
    text = F.coalesce("text", F.lit(""))
    counted = messages.select("conv_id", "turn", text.alias("text"), count(text).cast("long").alias("n"))
    kind = messages.schema["conv_id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, group in itertools.groupby(rows(batches), key=lambda r: r[0]):
            for k, (a, b, n, texts) in enumerate(open_chunks((r[1:] for r in group), most, overlap)):
                out.append((conv, k, a, b, n, "\n".join(texts)))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], CHUNKS)
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], CHUNKS)

    types = [to_arrow_type(kind), *[pa.int64()] * 4, pa.string()]
    ordered = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text")
    return ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, chunk long, first_message long, end_message long, n_tokens long, chunk_text string")


def parse_lines(logs: DataFrame) -> DataFrame:
    """(log_id, line_no, ts, nick, message) of chat lines like `12:00 <nick> text`; other lines are dropped."""
    lines = logs.select("log_id", F.posexplode(F.split("raw", "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")).alias("line_no", "line"))
    pattern = r"(?s)^([^<]*)<([^>]*)>(.*)$"
    held = lines.where(F.col("line").rlike(pattern))
    return held.select(
        "log_id", "line_no", F.regexp_extract("line", r"^\s*([^<\s]*)[^<]*<", 1).alias("ts"), F.regexp_extract("line", pattern, 2).alias("nick"),
        F.regexp_replace(F.regexp_extract("line", pattern, 3), r"(?U)^\s+|\s+$", "").alias("message"),
    )


def tiles(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into at most so many rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def chunked(batches: Iterator, size: int) -> Iterator[list]:
    """Lists of at most `size` items, for adapters that take batches."""
    held: list = []
    for x in batches:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def enriched(chunks: DataFrame, enrich: Callable[[Column], Column] = lambda text: text, text: str = "text") -> DataFrame:
    """Chunks with `enriched_text`, what the hook makes of their text: the text itself unless a hook is given."""
    return chunks.withColumn("enriched_text", enrich(F.col(text)))
