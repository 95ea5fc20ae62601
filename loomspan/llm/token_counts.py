"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A leaf covers some dozens of pre-tokens and holds their characters and tokens; inner
nodes hold sums. The vocabulary never merges across pre-tokens, and the split from a
pre-token's start depends on nothing to its left. So after an edit only the leaves that
it touches are split and counted again, with the leaf before them as context and as far
to the right as it takes until an old leaf boundary is met; then sums change on their
paths to the root alone. Trees are kept as a table, by the characters and tokens of their
leaves, and a batch of edits turns that table into the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.llm.text import slices

LEAF = 64
CACHE = 400_000


class Counter:
    """Tokens of a pre-token, through a bounded cache."""

    def __init__(self, path: str | None = None, most: int = CACHE):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            keep = len(known) < self.most
            for i, x in enumerate(out):
                if x is None:
                    out[i] = x = known[pieces[i]] if pieces[i] in known else len(self.encoding.encode_ordinary(pieces[i]))
                    if keep:
                        known[pieces[i]] = x
        return out

    def whole(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


_counters: dict[str | None, Counter] = {}


def counter_for(path: str | None) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


class TokenTree:
    """Text, leaves and sums; `edit` keeps the count right and says what it counted again."""

    def __init__(self, text: str, counter: Counter, leaf: int = LEAF):
        self.text, self.counter, self.leaf = text, counter, leaf
        pieces = counter.pattern.findall(text)
        chars, tokens = self._leaves(pieces, max(1, -(-len(pieces) // leaf)))
        self._build(chars, tokens)

    @classmethod
    def stored(cls, text: str, chars: list[int], tokens: list[int], counter: Counter, leaf: int = LEAF) -> TokenTree:
        """The tree that was stored by its leaves; nothing is split or counted."""
        tree = cls.__new__(cls)
        tree.text, tree.counter, tree.leaf = text, counter, leaf
        tree._build(np.array(chars, np.int64), np.array(tokens, np.int64))
        return tree

    def _leaves(self, pieces: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of `n` leaves of nearly equal numbers of pre-tokens."""
        if not pieces:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        starts = np.arange(n) * len(pieces) // n
        full = np.diff(np.append(starts, len(pieces))) > 0
        both = []
        for values in (list(map(len, pieces)), self.counter.of(pieces)):
            sums = np.zeros(n, np.int64)
            sums[full] = np.add.reduceat(np.array(values, np.int64), starts[full])
            both.append(sums)
        return both[0], both[1]

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.levels = [np.stack([chars, tokens])]
        while self.levels[-1].shape[1] > 1:
            low = self.levels[-1]
            if low.shape[1] % 2:
                low = np.concatenate([low, np.zeros((2, 1), np.int64)], axis=1)
            self.levels.append(low[:, ::2] + low[:, 1::2])

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][1, 0])

    @property
    def n_leaves(self) -> int:
        return self.levels[0].shape[1]

    def _find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's start: down the tree by sums."""
        i, start = 0, 0
        for level in reversed(self.levels[:-1]):
            i *= 2
            if i + 1 < level.shape[1] and start + level[0, i] <= char:
                start += int(level[0, i])
                i += 1
        return i, start

    def edit(self, start: int, end: int, new: str) -> tuple[int, int]:
        """Replace text[start:end]; returns (leaves counted again, characters counted again)."""
        start, end = max(0, min(start, len(self.text))), max(0, min(end, len(self.text)))
        end = max(start, end)
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        first, at = self._find(start)
        for _ in range(2):  # the context: one leaf that holds characters
            if first and (at >= start or _ == 0):
                first -= 1
                at -= int(self.levels[0][0, first])
        last, edge = self._find(end)
        edge += int(self.levels[0][0, last])  # the end of the leaf, in the old text
        pieces, stop = [], at
        for m in self.counter.pattern.finditer(text, at):
            pieces.append(m.group())
            stop = m.end()
            while edge + shift < stop and last + 1 < self.n_leaves:
                last += 1
                edge += int(self.levels[0][0, last])
            if stop == edge + shift and stop >= start + len(new) and edge >= end:
                break
        else:
            last = self.n_leaves - 1
        self.text = text
        n = last - first + 1
        if n * self.leaf // 4 <= len(pieces) <= n * self.leaf * 2 or n == self.n_leaves and len(pieces) <= 2 * n * self.leaf:
            chars, tokens = self._leaves(pieces, n)
            self.levels[0][:, first : last + 1] = chars, tokens
            low, high = first, last
            for k in range(1, len(self.levels)):  # sums on the paths to the root
                below, low, high = self.levels[k - 1], low // 2, high // 2
                for i in range(low, high + 1):
                    self.levels[k][:, i] = below[:, 2 * i : 2 * i + 2].sum(1)
        else:  # too many or too few for these leaves: other leaves keep their sums
            n = max(1, -(-len(pieces) // self.leaf))
            chars, tokens = self._leaves(pieces, n)
            old = self.levels[0]
            self._build(np.concatenate([old[0, :first], chars, old[0, last + 1 :]]), np.concatenate([old[1, :first], tokens, old[1, last + 1 :]]))
        return n, stop - at


#: A stored tree: the text, and the characters and tokens of its leaves; inner sums follow from these.
TREE = "text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"
EDITS = "array<struct<seq:int,start:long,end:long,new:string>>"


def build_trees(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens, n_tokens): the tree of every document, to be written as a table.

    A null text counts as empty, with no tokens. Repeated rows have trees of their own; other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(path)
        for batch in slices(batches):
            trees = [TokenTree(t or "", counter, leaf) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_stored(trees)], ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {TREE}")


def _stored(trees: list[TokenTree]) -> list[pa.Array]:
    leaves = [t.levels[0] for t in trees]
    return [pa.array([t.text for t in trees], pa.string()), *(pa.array([x[i].astype(np.int32) for x in leaves], pa.list_(pa.int32())) for i in (0, 1)), pa.array([t.tokens for t in trees], pa.int64())]


def _with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    one = edits.where("doc_id IS NOT NULL").select("doc_id", F.col("seq").cast("int"), F.col("start").cast("long"), F.col("end").cast("long"), "new").dropDuplicates(["doc_id", "seq"])
    grouped = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "new"))).alias("edits"))
    return trees.join(grouped, "doc_id", "left")


def edit_trees(trees: DataFrame, edits: DataFrame | Column, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The stored trees after a batch of edits, with what was counted again: TREE's columns, recounted_leaves, recounted_chars, n_leaves_before, tokens_before.

    edits: a table doc_id, seq, start, end, new, which is joined by id, or a column of the trees of type EDITS, which
    needs no join and so moves no text; a document's edits apply in order of seq, each in
    the coordinates that the ones before leave, and to every tree of its id. Repeated
    edits of one seq in a table count once. A document without edits keeps its tree, and so
    does one without an id if a table has them; nothing of it is split or counted. Positions beyond a text mean its end, a null
    one its start, a null text is an empty one. Of a document's edits all are held together, of a
    table none.
    """
    kind = trees.schema["doc_id"].dataType.simpleString()
    told = trees.withColumn("edits", F.array_sort(edits)) if isinstance(edits, Column) else _with_edits(trees, edits)
    return _edited(told, kind, path, leaf)


def _edited(told: DataFrame, kind: str, path: str | None, leaf: int) -> DataFrame:
    """The trees (doc_id, text, leaf_chars, leaf_tokens, edits) after their edits."""
    names = ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "recounted_leaves", "recounted_chars", "n_leaves_before", "tokens_before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(path)
        for batch in slices(batches):
            done, facts = [], []
            for text, chars, tokens, todo in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                tree = TokenTree.stored(text or "", chars, tokens, counter, leaf)
                before = tree.n_leaves, tree.tokens
                again = [tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "") for e in todo or ()]
                done.append(tree)
                facts.append((sum(a for a, _ in again), sum(b for _, b in again), *before))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_stored(done), *(pa.array([f[j] for f in facts], pa.int64()) for j in range(4))], names)

    rows = told.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits")
    return rows.mapInArrow(run, f"doc_id {kind}, {TREE}, recounted_leaves long, recounted_chars long, n_leaves_before long, tokens_before long")


def base_of(text: Column) -> Column:
    """What an edit names as the text that it was made for; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def leaf_table(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, base, leaf_chars, leaf_tokens, n_tokens): the trees of documents without their texts, which stay where they are."""
    trees = build_trees(docs, path, leaf)
    return trees.select("doc_id", base_of(F.col("text")).alias("base"), "leaf_chars", "leaf_tokens", "n_tokens")


def edit_documents(docs: DataFrame, leaves: DataFrame, edits: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """TREE's columns and what was counted again, as `edit_trees` tells, of every document after a table of edits.

    leaves: what `leaf_table` gives for the documents; edits: doc_id, base, seq, start, end,
    new. Edits and leaves meet by keys alone, a row for each text of an id, and only then
    the texts join them, once; a null id is an id like any other. Edits of other texts of
    an id, or of other ids, apply to nothing, repeated ones of one seq once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # a null id must not be lost in the join: it has a flag of its own
    keyed = lambda df, *more: df.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"), "base", *more)
    one = F.min(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "new"))
    each = keyed(edits, F.col("seq").cast("int").alias("seq"), "start", "end", "new").groupBy("none", "id", "base", "seq").agg(one.alias("e"))
    todo = each.groupBy("none", "id", "base").agg(F.array_sort(F.collect_list(F.struct("seq", "e.start", "e.end", "e.new"))).alias("edits"))
    trees = keyed(leaves, "leaf_chars", "leaf_tokens").groupBy("none", "id", "base").agg(F.first("leaf_chars").alias("leaf_chars"), F.first("leaf_tokens").alias("leaf_tokens"))
    both = trees.join(todo, ["none", "id", "base"], "left")
    text = F.coalesce("text", F.lit(""))
    texts = keyed(docs.select("doc_id", text.alias("text"), base_of(F.col("text")).alias("base")), "text", "doc_id")
    told = texts.join(both.hint("shuffle_hash"), ["none", "id", "base"], "left")
    return _edited(told, kind, path, leaf)


def sample_edits() -> Column:
    """The edits of the registered query for a text: a masked stretch at a third, a note at two thirds, a cut end."""
    n = F.length("text").cast("long")
    third, note = F.expr("cast(length(text) div 3 as long)"), F.expr("cast(2 * length(text) div 3 as long)")
    masked = F.struct(F.lit(0).alias("seq"), third.alias("start"), F.least(n, third + 12).alias("end"), F.lit(" [masked] ").alias("new"))
    noted = F.struct(F.lit(1).alias("seq"), note.alias("start"), note.alias("end"), F.lit(" (see note)\n").alias("new"))
    cut = F.struct(F.lit(2).alias("seq"), (n + (22 - (F.least(n, third + 12) - third)) - 5).alias("start"), (n + 22).alias("end"), F.lit("").alias("new"))
    return F.array(masked, noted, cut)


def sample_feed(docs: DataFrame) -> DataFrame:
    """(doc_id, base, seq, start, end, new): the sample edits of all documents as a feed of edits would hold them."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.select("doc_id", base_of(F.col("text")).alias("base"), F.explode(sample_edits()).alias("e")).select("doc_id", "base", "e.*")


def count_with_edits(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_leaves, edited_tokens, recounted_leaves, recounted_chars, edited_chars of every document: its tree, written, and what a written table of edits makes of it."""
    leaves = scratch.materialize(leaf_table(docs, path), "leaves")
    edits = scratch.materialize(sample_feed(docs), "edits")
    edited = edit_documents(docs, leaves, edits, path)
    return edited.select(
        "doc_id", F.col("tokens_before").alias("n_tokens"), F.col("n_leaves_before").alias("n_leaves"), F.col("n_tokens").alias("edited_tokens"), "recounted_leaves", "recounted_chars",
        F.length("text").cast("long").alias("edited_chars"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op6_token_counts": op6_token_counts}
