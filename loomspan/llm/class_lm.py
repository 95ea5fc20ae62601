"""Language-model scoring with a Brown class-based bigram model.

Exchange clustering assigns items to classes so as to maximise the likelihood of class
bigrams. Every frequent word is an item, and shapes (endings) are the items that all other
words share, so every word has a class. The exchange starts on the items' core, the most
frequent words and the shapes, one item at a time on its dense counts. Then all items are
exchanged in rounds over the whole corpus: an item's sparse counts with the classes before
and after it are summed in tasks, and each item of the round's half moves to its best class;
a round that makes training texts less likely is taken back and ends the rounds (distributed exchange, as by
Uszkoreit and Brants, 2008). Words beyond the items, however many, are exchanged once more,
against the items' classes, and their classes stay a table that texts meet by a join. Words too
rare to be told apart by their own bigrams keep the class of their ending. A text's probability is the product of class transitions (Witten-Bell
smoothed) and word emissions (absolute discounting; the discounted mass of a class is that of its unseen words).

Counts cover all training texts. Texts are encoded once, as item numbers in a written table,
from which all rounds are computed, and then once as classes, from which the scores are. Only tables of bounded size reach the
driver and the tasks: at most the `TOP` most frequent words and their classes, the bigrams
of at most `WORDS + SHAPES + 2` items, and those of classes. Sparse counts, and the counts and classes of all other words, stay distributed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.llm.text import FOLD, slices, utf8

#: Words that are items, which tasks hold; the others' classes are joined.
TOP = 150_000
WORDS = 600
SHAPES = 400
CLASSES = 40
#: Rounds over the core at most, and rounds over all items at most, each of which may move one half of them.
ROUNDS, SWEEPS = 6, 4
#: Times that a word outside the core must occur to be exchanged by its own bigrams.
LEAST = 3
FOLDS = 10
ALPHA = 0.1
#: The end of a text; no word can be it, since words have no spaces.
END = b" "


def words_of(text: bytes) -> list[bytes]:
    """Runs of anything but 0x20 and 0x09-0x0D, A-Z as a-z."""
    return text.translate(FOLD).split()


def shape_of(word: bytes) -> bytes:
    """What a word that is not an item of its own looks like: its ending, with marks for digits and symbols."""
    last = word[-1]
    if 97 <= last <= 122 or last >= 0x80:
        return b" " + word[-2:]
    if 48 <= last <= 57:
        return b" 0"
    return b" " + word[-3:-1] + b"!" + word[-1:] if len(word) > 2 else b" !" + word[-1:]


def held_out(key) -> bool:
    """Whether crc32 of the id as text leaves no remainder by 10; a null id counts as empty text."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % FOLDS == 0


class Items:
    """Item numbers: frequent words by frequency, then shapes, then all other shapes as one, then the end of a text."""

    def __init__(self, words: list[bytes], shapes: list[bytes]):
        self.words = {w: i for i, w in enumerate(words)}
        self.shapes = {s: len(words) + i for i, s in enumerate(shapes)}
        self.rest = len(words) + len(shapes)
        self.end = self.rest + 1
        self.n = self.end + 1

    def of(self, word: bytes) -> int:
        found = self.words.get(word)
        return self.shapes.get(shape_of(word), self.rest) if found is None else found


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all training texts; the end of a text counts as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if not held_out(key):
                    counts.update(words_of(text))
                    counts[END] += 1
            if len(counts) > 400_000:
                yield out()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, top: int) -> tuple[list[tuple[bytes, int]], int, int]:
    """The most frequent words with their counts, then the sum of all counts and their number, the end included.

    Words are taken by bins of counts, a 64th of an octave wide, as long as no more than
    `top` come together; all words of equal count are taken or none. The driver gets a row
    for each bin and these words, however many partitions the counts have.
    """
    is_end = F.col("word") == F.lit(END)
    bins = counts.groupBy(F.floor(F.log2("n") * 64).alias("bin")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.count_if(~is_end).alias("words"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    least, taken = None, 0
    for row in bins:
        taken += row.words
        if taken > top:
            break
        least = row.least
    found = [] if least is None else [(bytes(r.word), int(r.n)) for r in counts.where((F.col("n") >= least) & ~is_end).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0])), sum(int(r.n) for r in bins), sum(int(r.kinds) for r in bins)


ENCODED = "held_out boolean, row long, ids binary, words array<binary>, times array<int>, shapes array<int>, places binary, which binary"
#: A class in a written text.
SMALL = "<u2"


def encode(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, held_out, row, ids, words, times, shapes, places, which): texts as little-endian 32-bit item numbers, the end's last, and the words that are no item of their own with how often they come and the items that they count as; places of such words in the text, and which each is."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    handle = docs.sparkSession.sparkContext.broadcast(items)
    fields = [("held_out", pa.bool_()), ("row", pa.int64()), ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())), ("shapes", pa.list_(pa.int32())), ("places", pa.binary()), ("which", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = handle.value
        get, serial = items.words.get, TaskContext.get().partitionId() << 36
        end = np.array([items.end], "<i4").tobytes()
        for batch in slices(batches):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = words_of(text)
                ids = np.fromiter(map(get, words, repeat(-1)), "<i4", len(words))
                places = np.flatnonzero(ids < 0).astype("<i4")
                others = [words[i] for i in places.tolist()]
                rare = Counter(others)
                number = dict(zip(rare, range(len(rare)), strict=True))
                which = np.fromiter(map(number.__getitem__, others), "<i4", len(others))
                shape = [items.of(w) for w in rare]
                ids[places] = np.array(shape, "<i4")[which]
                rows.append((held_out(key), serial, ids.tobytes() + end, list(rare), list(rare.values()), shape, places.tobytes(), which.tobytes()))
                serial += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(fields))], ["doc_id", *(n for n, _ in fields)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {ENCODED}")


def lines(batches: Iterator[pa.RecordBatch], end: int, kind: str = "<i4") -> Iterator[np.ndarray]:
    """Item numbers, or classes, of slices of encoded texts one after the other, each text after an end."""
    for batch in slices(batches, "ids", 8 << 20):
        yield np.concatenate([np.array([end], np.int32), np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind)])


def count_pairs(encoded: DataFrame, groups: np.ndarray, kind: str = "<i4") -> np.ndarray:
    """Bigrams of groups of items, groups[item], over all training texts; the end is the last item."""
    k, end = int(groups.max()) + 1, len(groups) - 1
    handle = encoded.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)  # at most WORDS + SHAPES + 2 squared
        for line in lines(batches, end, kind):
            c = handle.value[line]
            total += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // k), pa.array(at % k), pa.array(total[at])], ["a", "b", "n"])

    table = np.zeros((k, k))
    rows = encoded.where("NOT held_out").select("ids").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for row in rows.toLocalIterator():  # a row for each pair of groups
        table[row.a, row.b] = row.n
    return table


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """A class for each item by exchange clustering; the last item, the end, keeps a class of its own.

    Maximises sum n(c,d) log n(c,d) - sum n(c) log n(c) over both margins by moving one
    item at a time to its best class, from frequent items to rare ones, until a round
    moves none or the rounds are over.
    """
    n = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = [int(i) for i in np.argsort(-weight, kind="stable") if i != n - 1]
    classes = max(2, min(classes, n))
    of = np.zeros(n, np.int64)
    of[n - 1] = classes - 1
    for rank, i in enumerate(order):
        of[i] = rank % (classes - 1)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    follow, lead = bigrams @ member, bigrams.T @ member  # item to class, class to item
    table = member.T @ follow
    for _ in range(rounds):
        moved = 0
        for i in order:
            if not weight[i]:
                continue
            old, loop = of[i], float(bigrams[i, i])
            out, into = follow[i].copy(), lead[i].copy()
            out[old] -= loop
            into[old] -= loop
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= loop
            rows, columns = table.sum(1), table.sum(0)
            n_out, n_in = out.sum() + loop, into.sum() + loop
            base = f(table)
            gain = (f(table + out) - base).sum(1) + (f(table + into[:, None]) - base).sum(0)
            own = np.diag(table)
            gain += f(own + out + into + loop) - f(own + out) - f(own + into) + np.diag(base)
            gain -= f(rows + n_out) - f(rows) + f(columns + n_in) - f(columns)
            gain[classes - 1] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += out
            table[:, new] += into
            table[new, new] += loop
            if new != old:
                moved += 1
                of[i] = new
                follow[:, old] -= bigrams[:, i]
                follow[:, new] += bigrams[:, i]
                lead[:, old] -= bigrams[i]
                lead[:, new] += bigrams[i]
        if not moved:
            break
    return of


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), Witten-Bell smoothed with the classes' own shares."""
    k = len(table)
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * k)
    kinds = np.maximum(1, (table > 0).sum(1, keepdims=True))
    return np.log10((table + kinds * share) / (table.sum(1, keepdims=True) + kinds))


def likelihood(table: np.ndarray) -> float:
    """The part of the training texts' log likelihood that classes decide, from their bigrams."""

    def f(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1))).sum())

    return f(table) - f(table.sum(0)) - f(table.sum(1))


def best_classes(at: np.ndarray, context: np.ndarray, n: np.ndarray, old: np.ndarray, table: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of most likelihood for each of len(old) words, and whether it is likelier than the old one.

    Word at[i] comes n[i] times in context[i]: before a class (0 to k - 1) or after it (k to 2k - 1).
    Empty classes and the end's take no word.
    """
    k = len(table)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    cells = np.concatenate([table.T, table])  # the cells of a context, by the word's class
    margins = np.stack([table.sum(1), table.sum(0)])  # of words before others, of words after others
    full = margins.sum(0) > 0
    full[end] = False
    gain = np.zeros((len(old), k))

    def add(to: np.ndarray, cell: np.ndarray, n: np.ndarray, sign: int) -> None:
        change = f(cell + n[:, None]) - f(cell)
        i = np.arange(len(to))
        here = cell[i, old[to]]
        change[i, old[to]] = f(here) - f(here - n)  # its own counts are in its old class already
        np.add.at(gain, to, sign * change)

    for s in range(0, len(at), 50_000):
        part = slice(s, s + 50_000)
        add(at[part], cells[context[part]], n[part].astype(float), 1)
    for side in (0, 1):
        total = np.bincount(at, np.where(context // k == side, n, 0), len(old))
        for s in range(0, len(old), 50_000):
            to = np.arange(s, min(len(old), s + 50_000))
            add(to, np.repeat(margins[side][None], len(to), 0), total[to], -1)
    stay = gain[np.arange(len(old)), old]
    gain[:, ~full] = -np.inf
    return gain.argmax(1), gain.max(1) > stay + 1e-9


def exchange_round(encoded: DataFrame, of: np.ndarray, table: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """The classes after each movable item has joined the class of most likelihood for its own bigrams, the others' classes as they were.

    The items' counts with classes are summed in tasks, then by item; the driver gets a number for each that moves.
    Empty classes and the end's take no item.
    """
    k, end = len(table), len(of) - 1
    small = np.int32 if len(of) * 2 * k < 1 << 31 else np.int64  # keys that are sorted in half the time
    handle = encoded.sparkSession.sparkContext.broadcast((of.astype(small), movable))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, movable = handle.value
        keys: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate([np.empty(0, small), *keys]), return_counts=True)
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array((key // (2 * k)).astype(np.int64)), pa.array((key % (2 * k)).astype(np.int32)), pa.array(n)], ["w", "context", "n"])

        for line in lines(batches, end):
            c = of[line]
            at = np.flatnonzero(movable[line[1:-1]]) + 1  # never the ends at both sides
            w = line[at].astype(small) * small(2 * k)
            keys.extend((w + c[at + 1], w + small(k) + c[at - 1]))
            if sum(map(len, keys)) > 6_000_000:
                yield out()
        yield out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)]) for b in batches if b.num_rows]
        if not got:
            return
        w, context, n = np.concatenate(got, axis=1)
        word, at = np.unique(w, return_inverse=True)
        new, moves = best_classes(at, context, n, handle.value[0][word], table, int(of[end]))
        yield pa.RecordBatch.from_arrays([pa.array(word[moves]), pa.array(new[moves])], ["w", "c"])

    rows = encoded.where("NOT held_out").select("ids").mapInArrow(contexts, "w long, context int, n long")
    # tasks have summed already; one shuffle by the item serves the sums and the choice
    sums = rows.repartition("w").groupBy("w", "context").agg(F.sum("n").alias("n"))
    found = sums.mapInArrow(choose, "w long, c long").toArrow()
    out = of.copy()
    out[found.column("w").to_numpy()] = found.column("c").to_numpy()
    return out


def classes_of_others(encoded: DataFrame, rare: DataFrame, items: Items, of: np.ndarray, table: np.ndarray, least: int) -> DataFrame:
    """(word, class) of the words that are no items but come `least` times: the class of most likelihood for their own bigrams, all other words' classes as they were.

    The words' pairs of classes around them are counted in tasks, then by word; no word has more than classes squared. The result is written.
    """
    k, end = len(table), len(of) - 1
    handle = encoded.sparkSession.sparkContext.broadcast((of, items.shapes, items.rest))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = handle.value[0]
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            words, pairs = [w for w, _ in counts], [x for _, x in counts]
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(pairs, pa.int64()), pa.array(counts.values(), pa.int64())], ["word", "pair", "n"])
            counts.clear()
            return made

        for batch in slices(batches, "ids", 8 << 20):
            for ids, words, places, which in zip(*(batch.column(x).to_pylist() for x in ("ids", "words", "places", "which")), strict=True):
                c = np.concatenate([of[np.frombuffer(ids, "<i4")], of[end:]])  # the last is the end before the text's first word, at -1
                at = np.frombuffer(places, "<i4")
                counts.update(zip(map(words.__getitem__, np.frombuffer(which, "<i4").tolist()), (c[at - 1] * k + c[at + 1]).tolist(), strict=True))
            if len(counts) > 400_000:
                yield out()
        yield out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shapes, rest = handle.value
        for batch in batches:
            words, lists = batch.column("word").to_pylist(), batch.column("pairs")
            if not words:
                continue
            old = of[np.array([shapes.get(shape_of(w), rest) for w in words])]
            at = np.repeat(np.arange(len(words)), np.array(lists.value_lengths()))
            pair, n = (lists.flatten().field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("pair", "n"))
            both = np.concatenate([at * (2 * k) + pair % k, at * (2 * k) + k + pair // k])  # before a class, and after one
            key, place = np.unique(both, return_inverse=True)
            new, moves = best_classes(key // (2 * k), key % (2 * k), np.bincount(place, np.concatenate([n, n])), old, table, int(of[end]))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(np.where(moves, new, old).astype(np.int32))], ["word", "class"])

    rows = encoded.where("NOT held_out AND size(words) > 0").select("ids", "words", "places", "which").mapInArrow(contexts, "word binary, pair long, n long")
    # one shuffle by the word serves both groupings and the join
    lists = rows.repartition("word").groupBy("word", "pair").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("pair", "n")).alias("pairs"))
    told = lists.join(rare.where(F.col("n") >= least).select("word"), "word", "left_semi")
    return scratch.materialize(told.mapInArrow(choose, "word binary, class int"), "classes")


def class_totals(rare: DataFrame, items: Items, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each class, and its kinds of words that occur at all, once and twice.

    n: of the words that are items, then of the end; rare: (word, n, class) of all other words, null where the class is the ending's.
    """
    k, end = int(of.max()) + 1, len(of) - 1
    handle = rare.sparkSession.sparkContext.broadcast((of, items.shapes, items.rest))

    def sums(classes: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(classes, x, k) for x in (n, n > 0, n == 1, n == 2)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shapes, rest = handle.value
        total = np.zeros((k, 4))
        for batch in batches:
            classes = [of[shapes.get(shape_of(w), rest)] if c is None else c for w, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            total += sums(np.array(classes, np.int64), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), *(pa.array(total[:, j].astype(np.int64)) for j in range(4))], ["c", "n", "kinds", "once", "twice"])

    totals = sums(of[[*range(len(n) - 1), end]], n)
    found = rare.select("word", "n", "class").mapInArrow(run, "c long, n long, kinds long, once long, twice long").groupBy("c").agg(*(F.sum(x).alias(x) for x in ("n", "kinds", "once", "twice")))
    for row in found.collect():  # a row for each class
        totals[row.c] += row.n, row.kinds, row.once, row.twice
    return totals[:, 0], totals[:, 1:]


@dataclass
class Model:
    """What scoring needs, all of bounded size: items with their classes, transitions, emissions of the frequent words, and what the corpus has in all."""

    items: Items
    counts: np.ndarray  # of the frequent words, then of the end
    of: np.ndarray  # the class of each item
    steps: np.ndarray  # log10 P(class | class before)
    discount: np.ndarray  # by class
    spare: np.ndarray  # the tokens' worth of a class's unseen words
    mass: np.ndarray  # what all emissions of a class are divided by
    train_tokens: int
    kinds: int
    likelihoods: list[float] = field(default_factory=list)  # of the training texts, after the core, each round, and the words that are no items


def learn(docs: DataFrame, top: int = TOP, words: int = WORDS, shapes: int = SHAPES, classes: int = CLASSES, sweeps: int = SWEEPS, least: int = LEAST) -> tuple[Model, DataFrame, DataFrame]:
    """The model, (word, n, class) of the training words that are no items, and the texts as classes, written.

    A class is null where it is the ending's. Classes of such words that make the training texts less likely are taken back.
    """
    counts = scratch.materialize(count_words(docs), "words")
    frequent, n_train, kinds = most_frequent(counts, top)
    ends = counts.where(F.col("word") == F.lit(END)).first()
    by_shape: Counter = Counter()
    for w, n in frequent[words:]:
        by_shape[shape_of(w)] += n
    items = Items([w for w, _ in frequent], [s for s, _ in sorted(by_shape.items(), key=lambda x: (-x[1], x[0]))[:shapes]])
    encoded = scratch.materialize(encode(docs, items), "encoded")
    core = min(words, len(frequent))
    # the core: its words for themselves, all other words by their shapes
    groups = np.empty(items.n, np.int64)
    groups[:core] = np.arange(core)
    groups[core : len(frequent)] = [items.shapes.get(shape_of(w), items.rest) - len(frequent) + core for w, _ in frequent[core:]]
    groups[len(frequent) :] = np.arange(items.n - len(frequent)) + core
    of = exchange(count_pairs(encoded, groups), classes)[groups]
    table = count_pairs(encoded, of)
    history = [likelihood(table)]
    n = np.array([n for _, n in frequent] + [int(ends.n) if ends else 0], np.float64)
    movable = np.ones(items.n, bool)
    movable[items.end] = False
    movable[core : len(frequent)] = n[core:-1] >= least
    own = groups.copy()  # words too rare to move go with their shapes
    own[: len(frequent)][movable[: len(frequent)]] = -1
    for sweep in range(sweeps):
        half = movable & (np.arange(items.n) % 2 == sweep % 2)
        if not half.any():
            continue
        moved = exchange_round(encoded, of, table, half)
        shape_class = moved[len(frequent) :]
        led = own[: len(frequent)] >= 0
        moved[: len(frequent)][led] = shape_class[own[: len(frequent)][led] - core]
        after = count_pairs(encoded, moved)
        if (moved == of).all() or likelihood(after) <= history[-1]:
            break
        of, table = moved, after
        history.append(likelihood(table))
    rare = counts.where(F.col("word") != F.lit(END))
    if frequent:
        rare = rare.where(F.col("n") < frequent[-1][1])
    ending = rare.withColumn("class", F.lit(None).cast("int"))
    others = [ending]
    if sweeps and (not frequent or frequent[-1][1] > least):  # there may be words that come often enough
        others.insert(0, scratch.materialize(rare.join(classes_of_others(encoded, rare, items, of, table, least), "word", "left"), "rare"))
    for words_left in others:
        model = emissions(items, n, of, *class_totals(words_left, items, of, n), n_train, kinds)
        texts = scratch.materialize(as_classes(model, words_left, encoded), "texts")
        table = count_pairs(texts, np.arange(len(table)), SMALL)
        if words_left is ending or likelihood(table) >= history[-1]:
            break
    model.steps = transitions(table)
    model.likelihoods = history if words_left is ending else [*history, likelihood(table)]
    return model, words_left, texts


def emissions(items: Items, n: np.ndarray, of: np.ndarray, tokens: np.ndarray, sorts: np.ndarray, n_train: int, kinds: int) -> Model:
    """A model without transitions: absolute discounting within each class."""
    discount = np.clip(sorts[:, 1] / np.maximum(1, sorts[:, 1] + 2 * sorts[:, 2]), 0.1, 0.9)
    spare = np.maximum(discount * np.maximum(sorts[:, 0], 1), 0.5)
    return Model(items, n, of, np.zeros((0, 0)), discount, spare, tokens - discount * sorts[:, 0] + spare, n_train, kinds)


def score_texts(docs: DataFrame, top: int = TOP, words: int = WORDS, shapes: int = SHAPES, classes: int = CLASSES, sweeps: int = SWEEPS, least: int = LEAST) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Null and empty texts have one token, the end. Repeated rows are scored, and learned
    from, as often as they come. Other columns are left out. With no training text all
    counts are 0 and every token has probability 1 in the base and in the model.
    """
    model, _, texts = learn(docs, top, words, shapes, classes, sweeps, least)
    return score_with(model, texts)


def as_classes(model: Model, rare: DataFrame, encoded: DataFrame) -> DataFrame:
    """(doc_id, held_out, ids, n_tokens, n_known, base, said): texts as classes, with the sums over their tokens that do not depend on what comes before.

    rare: (word, n, class) of the training words that are no items. They meet the texts' words by a join, and the texts by their rows.
    """
    spark, n_train, end = encoded.sparkSession, model.train_tokens, model.items.end
    kind = encoded.schema["doc_id"].dataType.simpleString()
    base_of = float(np.log10(n_train + ALPHA * (model.kinds + 1))) if n_train else 0.0
    frequent = len(model.counts) - 1
    known = np.zeros(model.items.n, bool)
    known[:frequent], known[end] = model.counts[:-1] > 0, model.counts[-1] > 0
    base, said = np.zeros(model.items.n), np.zeros(model.items.n)
    if n_train:
        at = [*range(frequent), end]
        c = model.of[at]
        base[at] = np.log10(model.counts + ALPHA) - base_of
        said[at] = np.log10(np.where(model.counts > 0, model.counts - model.discount[c], model.spare[c]) / model.mass[c])
    handle = spark.sparkContext.broadcast((known, base, said, model.of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, said, of = handle.value
        for batch in slices(batches, "ids", 8 << 20):
            rows = []
            for raw in batch.column("ids").to_pylist():
                ids = np.frombuffer(raw, "<i4")
                rows.append((of[ids].astype(SMALL).tobytes(), len(ids), int(known[ids].sum()), float(base[ids].sum()), float(said[ids].sum())))
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            kept = ["doc_id", "held_out", "row", "places", "which"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *columns], [*kept, "ids", "n_tokens", "n_known", "base", "said"])

    partial = encoded.select("doc_id", "held_out", "row", "ids", "places", "which").mapInArrow(run, f"doc_id {kind}, held_out boolean, row long, places binary, which binary, ids binary, n_tokens long, n_known long, base double, said double")
    each = encoded.select("row", F.posexplode(F.arrays_zip("words", "times", "shapes")).alias("j", "x")).select("row", "j", F.col("x.words").alias("word"), F.col("x.times").alias("times"), F.col("x.shapes").alias("item"))
    shaped = [(i, int(model.of[i])) for i in range(frequent, end)]  # at most SHAPES + 1
    constants = [(c, float(model.discount[c]), float(model.spare[c]), float(model.mass[c])) for c in range(len(model.mass))]
    each = each.join(rare, "word", "left").join(F.broadcast(spark.createDataFrame(shaped, "item int, ending int")), "item")
    each = each.withColumn("class", F.coalesce("class", "ending")).join(F.broadcast(spark.createDataFrame(constants, "class int, discount double, spare double, mass double")), "class")
    n, zero = F.coalesce("n", F.lit(0)), F.lit(0.0)
    emitted = F.log10(F.when(n > 0, n - F.col("discount")).otherwise(F.col("spare")) / F.col("mass"))
    rest = each.groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(n + F.lit(ALPHA)) - F.lit(base_of)) if n_train else zero).alias("more_base"),
        F.sum(F.col("times") * emitted if n_train else zero).alias("more_said"),
        F.transform(F.array_sort(F.collect_list(F.struct("j", "class"))), lambda x: x["class"]).alias("classes"),  # as many as one text has
    )
    both = partial.join(rest, "row", "left").select(
        "doc_id", "held_out", "ids", "places", "which", "classes", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base"), (F.col("said") + F.coalesce("more_said", zero)).alias("said"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["doc_id", "held_out", "n_tokens", "n_known", "base", "said"]
        for batch in slices(batches, "ids", 8 << 20):
            out = []
            for ids, places, which, classes in zip(*(batch.column(x).to_pylist() for x in ("ids", "places", "which", "classes")), strict=True):
                if classes:
                    c = np.frombuffer(ids, SMALL).copy()
                    c[np.frombuffer(places, "<i4")] = np.array(classes, SMALL)[np.frombuffer(which, "<i4")]
                    ids = c.tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(out, pa.binary())], [*kept, "ids"])

    return both.mapInArrow(place, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, said double, ids binary")


def score_with(model: Model, texts: DataFrame) -> DataFrame:
    """The scores of texts as classes of a model."""
    n_train, first = model.train_tokens, int(model.of[-1])
    kind = texts.schema["doc_id"].dataType.simpleString()
    handle = texts.sparkSession.sparkContext.broadcast(model.steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, kept = handle.value, ["doc_id", "held_out", "n_tokens", "n_known", "base", "said"]
        for batch in slices(batches, "ids", 8 << 20):
            moved = []
            for raw in batch.column("ids").to_pylist():
                c = np.frombuffer(raw, SMALL).astype(np.int64)
                moved.append(float(steps[np.concatenate(([first], c[:-1])), c].sum()) if n_train else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(moved, pa.float64())], [*kept, "moved"])

    out = texts.select("doc_id", "held_out", "n_tokens", "n_known", "base", "said", "ids").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, said double, moved double")
    score = F.col("said") + F.col("moved")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"),
        score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op3_class_lm": op3_class_lm}
