"""Best-fit packing of tokenised documents by a linear grouping scheme.

Only the counts of piece lengths reach the driver: at most `capacity` numbers. Large
lengths are rounded up within groups of equal cardinality; a column-generation program
over the few rounded sizes chooses how often each configuration is used; real pieces
take the slots, the last one the longest that fits; sequences that this fills stay, and
what is left is grouped again; then the small pieces go where they fit best. The plan is
a list of runs (so many pieces of one length go to so many consecutive sequences), whose
number depends on the capacity, not on the number of documents. Pieces find their place
by their rank among the pieces of their length, which a grouped count over tasks gives
without gathering any length's pieces.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.llm.text import slices, trim

CAPACITY = 4096
END_ID = 1
GROUPS = 32
#: What is tried: pieces longer than this part of the capacity are large; then, step by step, the free tokens that a sequence of a configuration may be left with.
SCHEDULES = ((6, (0, 0, 0, 2, 4, 8, 16, 32, 64, 128)), (6, (0,)), (3, (0,)))
#: Distinct words whose ids a worker process keeps.
CACHE = 800_000
#: Bytes of texts whose words are looked up at once.
AT_ONCE = 1 << 19


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _sides() -> tuple[bytes, bytes]:
    """What a Latin-1 byte is on the left and on the right of a place, in bits; the place parts words where both have a bit in common.

    Bit 0: a letter, then an ASCII mark or digit; bit 1: one of these but an apostrophe,
    then a letter; bits 2 and 3: the begin and the end of white space. Letters are a-z and
    those from U+00DF on; nothing is said of other bytes beyond ASCII, nor of A-Z.
    """
    left, right = bytearray(256), bytearray(256)
    for c in range(256):
        if c in b" \n":
            left[c], right[c] = 4, 8
            continue
        left[c], right[c] = 8, 4
        if 97 <= c <= 122 or c >= 0xDF and c != 0xF7:
            left[c], right[c] = left[c] | 1, right[c] | 2
        elif 0x20 < c < 0x7F and not 65 <= c <= 90:
            left[c], right[c] = left[c] | (0 if c == 0x27 else 2), right[c] | 1
    return bytes(left), bytes(right)


def _byte_names() -> dict[int, str]:
    """The characters by which vocabularies of bytes name them."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = _byte_names()


class _Words:
    """Words of at most 16 Latin-1 bytes and their ids, looked up many at once.

    A word's key is its bytes as two numbers, so keys tell words apart exactly.
    """

    LEFT, RIGHT = _sides()
    KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def __init__(self, kind: np.dtype, most: int):
        self.bits = max(8, (2 * most).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.n, self.most = 0, most
        self.low, self.high, self.start, self.size = (np.zeros(1024, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        self.used, self.pool = 0, np.zeros(4096, kind)

    def _room(self, words: int, ids: int) -> None:
        for name, need in (("low", words), ("high", words), ("start", words), ("size", words), ("pool", ids)):
            if len(held := getattr(self, name)) < need:
                setattr(self, name, np.concatenate((held, np.zeros(max(len(held) // 2, need - len(held)), held.dtype))))

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The numbers of words, -1 where they are not known."""
        with np.errstate(over="ignore"):
            at = ((low * self.FACTORS[0] + (high ^ (low >> np.uint64(29))) * self.FACTORS[1]) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots.take(at, mode="clip")  # the default mode checks each index, for twice the time
        rest = np.flatnonzero((found >= 0) & ((self.low.take(found, mode="clip") != low) | (self.high.take(found, mode="clip") != high)))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.slots) - 1)
            found[rest] = again = self.slots.take(at[rest])
            rest = rest[(again >= 0) & ((self.low.take(again) != low[rest]) | (self.high.take(again) != high[rest]))]
        self.at = at
        return found

    def add(self, low: np.ndarray, high: np.ndarray, slots: list[int], ids: list[bytes]) -> int:
        """Number distinct new words after those known; all or none are kept. Those that are not kept hold until the next call; a slot of -1 is not kept."""
        sizes = np.array([len(x) for x in ids], np.int64) // self.pool.itemsize
        raw = np.frombuffer(b"".join(ids), self.pool.dtype)
        first, stop = self.n, self.n + len(ids)
        self._room(stop, self.used + len(raw))
        self.low[first:stop], self.high[first:stop], self.size[first:stop] = low, high, sizes
        self.start[first:stop] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(raw)] = raw
        if stop <= self.most:
            for number, at in enumerate(slots, first):
                if at >= 0:
                    while self.slots[at] >= 0:
                        at = (at + 1) & (len(self.slots) - 1)
                    self.slots[at] = number
            self.n, self.used = stop, self.used + len(raw)
        return first


class Encoder:
    """Ids of whole texts, word by word with a bounded cache.

    The vocabulary's pre-tokens never span white space and its normaliser treats the
    parts between ASCII spaces alike wherever they stand, so a text's ids are those of
    its space-separated parts in order. It also lower-cases letter by letter, as Python
    does but for the final sigma, so words are looked up in lower case. Where its pattern
    of pre-tokens looks at nothing around them, texts of Latin-1 alone are also parted at
    line breaks and between letters and marks, and their words are looked up many at once.
    """

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.known: dict[str, bytes] = {}
        self.most = most
        self.ends, self.pattern = self._word_ends(path)
        looks = ("(?", "$", "|^", "(^", "\\b", "\\B", "\\G")
        probe = "aé,b'.é\n''s;it's5a.'t"
        self.parted = self.pattern is not None and not any(x in "|" + self.pattern.pattern for x in looks) and self.pattern.findall(probe) == ["a\u00e9", ",", "b", "'.", "\u00e9", "''", "s", ";", "it", "'s", "5", "a", ".'", "t"]
        self.words = _Words(self.kind, most)
        self.model = self.tokenizer.model
        letters = [c for c in map(chr, range(256)) if c.isalpha() and c == c.lower()]
        probes = [*letters, *("a" + c for c in letters), "".join(letters)]
        self.direct = self.parted and list(map(self._letters, probes)) == list(self._each(probes))
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _word_ends(self, path: str) -> tuple[np.ndarray | None, regex.Pattern | None]:
        """Which ids end a pre-token, and the pattern of pre-tokens; None where the vocabulary does not mark ends."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        pattern = steps[0].get("pattern", {}).get("Regex") if steps[0].get("type") == "Split" and steps[0].get("invert") else None
        if not suffix or not pattern:
            return None, None
        ends = np.zeros(max(self.tokenizer.get_vocab(True).values()) + 1, bool)
        ends[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith(suffix)]] = True
        return ends, regex.compile(pattern)

    def _pre_tokens(self, word: str) -> int:
        return 1 if word.isalpha() else len(self.pattern.findall(word if word.isascii() else unicodedata.normalize("NFC", word)))

    def _each(self, words: list[str]) -> Iterator[bytes]:
        for got in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(got.ids, self.kind).tobytes() if self.wide else array("H", got.ids).tobytes()

    def _lines(self, words: list[str], size: int = 200) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of distinct words, encoded many to a line and told apart by the ids that end pre-tokens.

        Where a line has not as many ends as its words should, its words are encoded singly.
        """
        lines = [words[i : i + size] for i in range(0, len(words), size)]
        for line, got in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            upto = np.cumsum(list(map(self._pre_tokens, line)))
            if upto[-1] != len(ends) or len(ids) and (not len(ends) or ends[-1] != len(ids)):
                yield from zip(line, self._each(line), strict=True)
                continue
            raw, start = ids.tobytes(), 0
            for word, stop in zip(line, (np.concatenate(([0], ends))[upto] * self.kind.itemsize).tolist(), strict=True):
                yield word, raw[start:stop]
                start = stop

    def _encode_latin(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of lower-case Latin-1 texts; their words are parted and looked up at once."""
        line = b" " + b" ".join(texts) + b" "
        left, right = (np.frombuffer(line.translate(t), np.uint8) for t in (_Words.LEFT, _Words.RIGHT))
        edges = left[:-1] & right[1:]
        starts, ends = np.flatnonzero((edges & 7) != 0) + 1, np.flatnonzero((edges & 11) != 0) + 1
        lengths = ends - starts
        wide = np.frombuffer(line + bytes(24), np.uint8).astype(np.uint64)
        for size in (1, 2, 4):  # each place's next 8 bytes as a number
            wide = wide[:-size] | (wide[size:] << np.uint64(8 * size))
        low = wide.take(starts, mode="clip") & _Words.KEPT.take(lengths, mode="clip")
        high = wide.take(starts + 8, mode="clip") & _Words.KEPT.take(lengths - 8, mode="clip")
        del left, right, edges, wide
        long = lengths > 16
        found = self.words.find(low, high)
        if len(missed := np.flatnonzero((found < 0) | long)):
            names = [line[a:b] for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)]
            number = {}
            nth = np.array([number.setdefault(w, len(number)) for w in names], np.int64)
            _, one = np.unique(nth, return_index=True)
            of = missed[one]
            made = self._made([w.decode("latin-1") for w in number])
            slots = np.where(long[of], -1, self.words.at[of])
            found[missed] = self.words.add(low[of], high[of], slots.tolist(), made) + nth
        sizes, words = self.words.size.take(found, mode="clip"), self.words
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ids = words.pool.take(np.repeat(words.start.take(found, mode="clip") - upto[:-1], sizes) + np.arange(upto[-1]), mode="clip")
        bounds = upto[np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))].tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield ids[a:b]

    def _made(self, new: list[str]) -> list[bytes]:
        """The ids of distinct words. One of letters alone is one pre-token, which the library's model takes as it is."""
        if not self.direct:
            made = dict(self._lines(new))
            return [made[w] for w in new]
        made = dict(self._lines([w for w in new if not w.isalpha()]))
        return [self._letters(w) if w.isalpha() else made[w] for w in new]

    def _letters(self, word: str) -> bytes:
        """The ids of a pre-token of lower-case Latin-1 letters."""
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES))]
        return np.array(ids, self.kind).tobytes() if self.wide else array("H", ids).tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if not self.parted:
            yield from self._encode_words(texts)
            return
        latin = [self._latin(t) for t in texts]
        others = self._encode_words([t for t, x in zip(texts, latin, strict=True) if x is None])
        found = self._encode_groups([x for x in latin if x is not None])
        for x in latin:
            yield next(others if x is None else found)

    def _latin(self, text: str) -> bytes | None:
        """A text in lower case as Latin-1, where it has no other letters, no zeros, which fill up keys, and no added tokens, whose letters and marks belong together."""
        try:
            raw = text.lower().encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if b"\0" in raw or any(t in raw for t in self.added) else raw

    def _encode_groups(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        first, size = 0, 0
        for i, text in enumerate(texts, 1):
            size += len(text)
            if size >= AT_ONCE or i == len(texts):
                yield from self._encode_latin(texts[first:i])
                first, size = i, 0

    def _encode_words(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Words beyond the cache's bound are kept for this call alone."""
        parts = [(t if "\u03a3" in t else t.lower()).split(" ") for t in texts]
        known = self.known
        new = list({w for words in parts for w in words} - known.keys())
        made: dict[str, bytes] = {}
        for i in range(0, len(new), 20_000):
            # the cache keeps copies made in a row: the texts' own words would each hold on to a block of freed memory
            some = " ".join(new[i : i + 20_000]).split(" ")
            made.update(zip(some, self._each(some), strict=True) if self.ends is None else self._lines(some))
        if len(known) + len(made) <= self.most:
            known.update(made)
            made = {}
        for words in parts:
            if made:
                yield np.frombuffer(b"".join([known[w] if w in known else made[w] for w in words]), self.kind)
            else:
                yield np.frombuffer(b"".join(map(known.__getitem__, words)), self.kind)


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """This worker process's encoder, whose cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "piece int, start long, length long, ids_crc32 long, task long, nth long"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; task and nth number the pieces of a length within a task."""
    path = path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("nth", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        task = TaskContext.get().partitionId()
        counts = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at, rows = [], []
            for i, ids in enumerate(encoder.encode(texts)):
                packed = np.empty(len(ids) + 1, "<u4")
                packed[:-1], packed[-1] = ids, end_id
                for piece, start in enumerate(range(0, len(packed), capacity)):
                    part = packed[start : start + capacity]
                    n = len(part)
                    rows.append((piece, start, n, zlib.crc32(part.tobytes()), task, int(counts[n])))
                    counts[n] += 1
                    at.append(i)
            columns = [pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], ["doc_id", *(n for n, _ in fields)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}")


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (size, value) in enumerate(zip(sizes, values, strict=True)):
        if value <= 1e-12:
            continue
        for start in range(0, capacity + 1 - size, size):  # each stretch of `size` positions depends on the one before
            stop = min(capacity + 1, start + 2 * size)
            got = best[start : stop - size] + value
            better = got > best[start + size : stop] + 1e-12
            best[start + size : stop][better] = got[better]
            choice[start + size : stop][better] = i
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0 and choice[room] >= 0:
        counts[choice[room]] += 1
        room -= sizes[choice[room]]
    return float(counts @ values), counts


def configurations(sizes: list[int], demand: list[int], capacity: int = CAPACITY, rounds: int = 2_000) -> list[tuple[tuple[int, ...], int]]:
    """(pieces of each size, times) that cover nearly all of the demand and nowhere exceed it, the most used first.

    Solves the fractional configuration program by column generation, until it is within
    a ten-thousandth of its bound, and rounds down; what is left over goes to the caller.
    """
    n = len(sizes)
    if n == 0:
        return []
    need = np.array(demand, float)
    basis = np.diag([float(capacity // size) for size in sizes])
    inverse = np.diag(1 / np.diag(basis))
    uses = inverse @ need
    for turn in range(rounds):
        value, column = _knapsack(sizes, inverse.sum(0), capacity)
        if value <= 1 + 1e-6 or uses.sum() - uses.sum() / value < 1e-4 * uses.sum():
            break
        step = inverse @ column
        ratio = np.full(n, np.inf)
        ratio[step > 1e-9] = uses[step > 1e-9] / step[step > 1e-9]
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        if turn % 100 == 99:  # against the drift of the updates
            inverse = np.linalg.inv(basis)
        uses = inverse @ need
    left, plan = need.copy(), []
    for i in np.argsort(-uses, kind="stable"):
        column = np.round(basis[:, i])
        times = int(min(np.floor(uses[i] + 1e-6), min((left[j] // column[j] for j in range(n) if column[j]), default=0)))
        if times > 0:
            left -= times * column
            plan.append((tuple(int(x) for x in column), times))
    return plan


class Runs:
    """Pieces of each length by rank, taken from the front, and the runs that place them."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.next = np.zeros(len(counts), np.int64)
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, pieces, first sequence, offset
        self.room: dict[int, list[tuple[int, int]]] = {}  # free tokens: (first sequence, sequences)
        self.sequences = 0

    def place(self, length: int, count: int, first: int, offset: int) -> None:
        self.rows.append((length, int(self.next[length]), count, first, offset))
        self.next[length] += count
        self.left[length] -= count

    def free(self, room: int, first: int, count: int) -> None:
        if room > 0:
            self.room.setdefault(room, []).append((first, count))


def _grouped(left: np.ndarray, capacity: int, groups: int, least: int) -> dict[int, int]:
    """Pieces by rounded length: groups of equal cardinality over the lengths from capacity - 1 to `least`, each rounded up to its longest."""
    lengths = np.arange(capacity - 1, least - 1, -1)
    lengths = lengths[left[lengths] > 0]
    total = int(left[lengths].sum())
    quota, before = max(1, -(-total // groups)), 0
    out: dict[int, int] = {}
    for x in lengths.tolist():
        n, head = int(left[x]), x
        if before % quota:  # the group that this length's first pieces join
            head = current
            first = min(n, quota - before % quota)
            out[head] += first
            before, n = before + first, n - first
        if n:
            current = x
            out[x] = out.get(x, 0) + n
            before += n
    return out


def _apply(runs: Runs, slots: list[int], times: int, capacity: int, least: int, waste: int) -> None:
    """Up to `times` sequences of one configuration, as long as they leave no more than `waste` tokens free.

    A slot takes the longest piece left that its rounded length admits, the last one the longest
    that the sequence still has room for: that is never less than its own size.
    """
    left, there = runs.left, runs.left > 0
    there[:least] = False
    while times > 0:
        room, picks = capacity, []
        for k, slot in enumerate(slots):
            most = min(room, slot) if k + 1 < len(slots) else room
            x = most - int(np.argmax(there[most::-1]))
            if not there[x]:
                break
            picks.append(x)
            room -= x
            left[x] -= 1
            there[x] = left[x] > 0
        for x in picks:
            left[x] += 1
            there[x] = True
        if not picks or room > waste:
            return
        n = min([times, *(int(left[x]) // picks.count(x) for x in set(picks))])
        at, first = 0, runs.sequences
        runs.sequences += n
        for x in picks:
            runs.place(x, n, first, at)
            there[x] = left[x] > 0
            at += x
        runs.free(room, first, n)
        times -= n


def _plan(counts: np.ndarray, capacity: int, groups: int, large: int, schedule: tuple[int, ...]) -> tuple[int, np.ndarray]:
    runs = Runs(counts)
    if n := int(runs.left[capacity]):
        runs.place(capacity, n, 0, 0)
        runs.sequences = n
    least = capacity // large + 1
    for waste in schedule:
        sizes = _grouped(runs.left, capacity, groups, least)
        heads = list(sizes)
        for column, times in configurations(heads, list(sizes.values()), capacity):
            _apply(runs, [heads[i] for i, n in enumerate(column) for _ in range(n)], times, capacity, least, waste)
    _best_fit(runs, capacity)
    return runs.sequences, np.array(sorted(runs.rows), np.int64).reshape(-1, 5)


def plan_runs(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, schedules: tuple = SCHEDULES) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, offset) for counts[length] pieces of each length.

    Each step of a schedule groups the large pieces that are left anew, solves for the
    configurations and keeps those of their sequences that the actual pieces fill up to
    the step's waste; the rest, and the small pieces, are placed by best fit. The plan
    of the schedule with the fewest sequences is taken; none is tried beyond one that
    reaches the bound, the sum of all lengths over the capacity.
    """
    bound = -(-int((counts * np.arange(len(counts))).sum()) // capacity)
    best = None
    for large, schedule in schedules:
        got = _plan(counts, capacity, groups, large, schedule)
        if best is None or got[0] < best[0]:
            best = got
        if best[0] <= bound:
            break
    return best[1]


def _best_fit(runs: Runs, capacity: int) -> None:
    """All pieces that are left, longest first, each to the sequence with the least sufficient room, else to a new one."""
    rooms = np.zeros(capacity + 1, bool)
    for room in runs.room:
        rooms[room] = True
    for length in range(capacity, 0, -1):
        while runs.left[length]:
            n = int(runs.left[length])
            at = int(np.argmax(rooms[length:])) + length
            if at <= capacity and rooms[at]:
                first, count = runs.room[at].pop()
                if not runs.room[at]:
                    rooms[at] = False
                used = min(n, count)
                runs.place(length, used, first, capacity - at)
                if used < count:
                    runs.free(at, first + used, count - used)
                    rooms[at] = True
                room = at - length
            else:
                per = capacity // length  # a new sequence takes as many of this length as fit
                used, first = max(1, n // per), runs.sequences
                runs.sequences += used
                mine = min(per, n)
                for k in range(mine):
                    runs.place(length, used, first, k * length)
                room = capacity - mine * length
            if room > 0:
                runs.free(room, first, used)
                rooms[room] = True


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, planner: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of one id, the end. Repeated rows are packed as
    often as they come; other columns are left out. An empty table gives no rows.
    """
    pieces = scratch.materialize(pieces_of(docs, capacity, path), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    per_task = scratch.materialize(per_task, "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row.length] = row.n
    runs = docs.sparkSession.sparkContext.broadcast((planner or functools.partial(plan_runs, capacity=capacity))(counts))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # the counts grow with lengths times tasks, so they are never broadcast; a length within a task is no hot key, and one number as key keeps the hash tables small
    group = (F.col("task") * (capacity + 1) + F.col("length")).alias("group")
    starts = per_task.select(group, F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.withColumn("group", group).join(starts.hint("shuffle_hash"), "group")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # their words are not needed any more
        trim()
        rows = runs.value
        span = int(rows[:, 1].max()) + int(rows[:, 2].max()) + 1 if len(rows) else 1
        keys = rows[:, 0] * span + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            sequence = rows[at, 3] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(rows[at, 4])], [*names, "sequence_id", "offset"])

    ranked = ranked.select(*names, (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
