"""Calls of models behind protocols, with deterministic stand-ins, so that every plan runs without a network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.operators import metrics
from loomspan.operators.chunking import chunked, tiles
from loomspan.sources import sinks

LEAST_ANSWER = 50


class Embedder(Protocol):
    dimensions: int

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Completer(Protocol):
    def __call__(self, prompt: str) -> str: ...


class HashEmbedder:
    """Unit vectors that depend on the text alone."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
            v = np.random.default_rng(seed).standard_normal(self.dimensions)
            out.append((v / np.linalg.norm(v)).tolist())
        return out


def echo(prompt: str) -> str:
    """A completion that repeats the end of its prompt as it is, with a space or line break where the cut falls."""
    return "Summary: " + prompt[-400:]


def checked_vectors(vectors: Sequence[Sequence[float]], count: int, dimensions: int) -> list[list[float]]:
    """The vectors, or an error: as many as texts, of one dimension, finite, not all zero."""
    matrix = np.asarray(vectors, np.float64)
    if matrix.shape != (count, dimensions) or not np.isfinite(matrix).all() or not matrix.any(axis=1).all():
        raise ValueError("the model gave vectors of a wrong number or shape, or with no finite direction")
    return matrix.tolist()


def embed(rows: DataFrame, model: Embedder, batch: int = 1000, key: str = "chunk_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(key, embedding) of every row, with the text between them if `carry`; a null text is embedded as an empty one. A failed call fails the task, which Spark repeats."""
    source = rows.select(key, text)
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (p for b in tiles(batches, batch) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for held in chunked(pairs, batch):
            vectors = checked_vectors(model([t or "" for _, t in held]), len(held), model.dimensions)
            texts = [pa.array([t for _, t in held], pa.string())] if carry else []
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held]), *texts, pa.array(vectors, pa.list_(pa.float32()))], [key, *[text] * carry, "embedding"])

    return source.mapInArrow(run, f"`{key}` {kind}, {f'`{text}` string, ' * carry}embedding array<float>")


def complete(prompt: str, model: Completer, tries: int = 3, least: int = LEAST_ANSWER) -> str:
    """An answer of at least `least` characters, asked for at most `tries` times; else the last error."""
    problem: Exception | None = None
    for _ in range(tries):
        try:
            answer = model(prompt).strip()
        except (OSError, ValueError) as error:
            problem = error
            continue
        if len(answer) >= least:
            return answer
        problem = ValueError(f"the answer has only {len(answer)} characters")
    raise RuntimeError("no usable answer") from problem


def joined_prompt(*sections: tuple[str, str | None]) -> str:
    """Headed sections one after the other, without empty ones; nothing is formatted, since logs hold braces."""
    return "\n\n".join(head + "\n" + body for head, body in sections if body)


def cache_key(text: Column, model: str) -> Column:
    """What identifies the vector of a text by a model; a null text counts as empty."""
    return F.sha2(F.concat(F.lit(model + "\n"), F.coalesce(text, F.lit(""))).cast("binary"), 256)


#: Bytes that a call costs beyond its text, and the most that one text may have.
OVERHEAD, MOST_BYTES = 32, 32_000


def budgeted(rows: DataFrame, cache: DataFrame, limit: int) -> DataFrame:
    """(account, seq, key, state) of rows (account, seq, text, key): cached, embedded, refused, or too long.

    A row that the cache (key) holds costs nothing; the others ask in order for their bytes,
    and one that does not fit the account's limit takes nothing.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + OVERHEAD
    held = cache.select("key").distinct().withColumn("__held", F.lit(True))
    told = rows.select("account", "seq", "key", size.alias("amount")).join(held, "key", "left")
    ask = told.where(F.col("__held").isNull() & (F.col("amount") <= MOST_BYTES))
    granted = metrics.admit(ask, limit).select("account", "seq", "admitted")
    both = told.join(granted, ["account", "seq"], "left")
    state = F.when(F.col("__held"), "cached").when(F.col("amount") > MOST_BYTES, "too long").when(F.col("admitted"), "embedded").otherwise("refused")
    return both.select("account", "seq", "key", state.alias("state"))


def embed_budgeted(rows: DataFrame, root: str, model: Embedder, limit: int) -> DataFrame:
    """(account, seq, key, state), after the vectors that the budget admits were added to the cache, a table below `root`.

    A run that dies leaves the cache as it was; what it had embedded is asked for again.
    """
    spark = rows.sparkSession
    found = sinks.current_table(spark, root)
    cache = spark.createDataFrame([], "key string, embedding array<float>") if found is None else found
    plan = scratch.materialize(budgeted(rows, cache, limit), "budget")
    wanted = rows.join(plan.where("state = 'embedded'").select("account", "seq"), ["account", "seq"], "left_semi").select("key", "text").dropDuplicates(["key"])
    sinks.replace_table(cache.unionByName(embed(wanted, model, key="key")), root)
    return plan


class IncompleteAnswer(RuntimeError):
    """An answer that ended at its limit; carries what there is of it."""

    def __init__(self, text: str):
        super().__init__("the answer ended at its limit")
        self.text = text


LONG_ANSWER, BRIEF_ANSWER = 8192, 1800


def answer(question: str, context: str, model: Callable[[str, int], tuple[str, str]], brief: bool = False, extra: str = "") -> str:
    """An answer from passages by a model that gives (text, reason of the end); an empty one is an error, one that ended at its limit carries its text."""
    asked = f"Question: {question}" + (f"\n\nAdditional instructions:\n{extra}" if extra else "") + f"\n\nPaper excerpts:\n{context}"
    text, reason = model(asked, BRIEF_ANSWER if brief else LONG_ANSWER)
    if not text.strip():
        raise ValueError("the model returned no answer")
    if reason == "length":
        raise IncompleteAnswer(text)
    return text


def searched_answer(question: str, search: Callable[[str], str], model: Completer) -> str:
    """Ask the model for a search query, search, and answer from what was found; the answer begins with the query."""
    wanted = model(joined_prompt(("Write a search query for this question.", question))).strip()
    return f"Search query: {wanted}\n\n" + model(joined_prompt(("Context", search(wanted)), ("Question", question)))


def with_retry(model: Embedder, message: str = "No embedding data received") -> Callable[[Sequence[str]], Sequence[Sequence[float]]]:
    """The model, asked once more where it fails with the message that stands for an empty reply; any other error stays."""

    def call(texts: Sequence[str]) -> Sequence[Sequence[float]]:
        try:
            return model(texts)
        except ValueError as error:
            if message not in str(error):
                raise
            return model(texts)

    return call
