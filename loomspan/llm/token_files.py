"""Token ids in compressed files: a context-mixing range coder over blocks.

A file tells its contexts' statistics in its header; a block is `BLOCK` ids, coded on its
own with a checksum of its ids. The next id is predicted by two parts, whose weights adapt
within each block to how far the first may be trusted:

- the list of the longest known context: of order 2 (hashed), where the last two ids mostly
  have few followers, else of order 1; it holds the followers that come more often there
  than anywhere, with their shares;
- order 0: all the file's ids, as counted.

How much of a context its list covers, and its order, choose a row of weights; rows are
counted anew at fixed places of a block. The range coder codes the part that predicts the
id, then the id within it. Blocks do not depend on one another, so the blocks of a file
are coded side by side, one step for an id of each; what contexts say is looked up in the
file's tables, which no step changes. A writer, who knows all ids, looks them up at once.

A file image is: `MAGIC`, the header's length (unsigned 32-bit, little-endian), the header
(JSON), the index of documents (an Arrow stream of keys and lengths), the counts, the
lists, the blocks' sizes and checksums, the blocks. A row of a Parquet table holds an image,
so that Spark's writers, and any store they reach, keep the files.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.llm.packing import END_ID, encoder_for, vocabulary_path
from loomspan.llm.text import slices

MAGIC = b"LSTOK2\n\0"
#: Ids of a block, blocks coded side by side, ids of a file (a longer document has a file to itself).
BLOCK, LANES, FILE_IDS = 2048, 4096, 1 << 23
#: Where a block's weights are taken anew.
PLACES = (128, *range(256, BLOCK, 256))
#: The sum of a file's counts, and that of a list's shares, as powers of two; lists of a file.
WHOLE_BITS, LIST_BITS, LISTS = 16, 10, 1 << 12
WHOLE = 1 << WHOLE_BITS
#: Times that a pair of context and follower must come; how many times more often than anywhere a follower of order 1 must come.
SEEN, MORE = 6, 1.5
#: Cells of the table in which a writer finds ids in lists, as a power of two; pairs that fall on one cell are left to order 0 but the most frequent.
FIND_BITS = 19
#: Rows of weights: without a list, then eight levels of order 1 and of order 2. What a row's first weight counts for; rows of more ids are halved.
ROWS, PRIOR, MOST = 17, 24, 1 << 20
#: The least weight of a part, of `WHOLE`.
FLOOR = 1 << 10
#: The coder's digits, the least span after a step, and the span at first: all numbers are whole and below 2**53, so floats hold them.
_DIGIT, _LEAST, _TOP = 2.0**16, 2.0**32, 2.0**48
#: The number of a file's first list; how many times wider a share of a list is than one of order 0.
_FIRST, _WIDER = 1 << WHOLE_BITS - LIST_BITS, 1 << WHOLE_BITS - LIST_BITS
#: Ids whose contexts a writer looks up at once, so that they stay in the processor's caches.
AT_ONCE = 1 << 16
_M1, _M2, _16 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(16)


def _hashed(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The number below 2**16 of a context of order 2."""
    return (last.astype(np.uint32) * _M1 + before.astype(np.uint32) * _M2) >> _16


def counts_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids ascending, counts that sum to `WHOLE`, none of them 0)."""
    all_counts = np.bincount(ids, minlength=1 << 16)
    distinct = np.flatnonzero(all_counts).astype(np.uint16)
    n = all_counts[distinct]
    if not len(distinct):
        return distinct, n
    shares = np.maximum(1, n * (WHOLE - len(distinct)) // n.sum())
    shares[shares.argmax()] += WHOLE - shares.sum()
    return distinct, shares


def _followers(contexts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, id, times of the pair, times of the context), by context and id; both below 2**16."""
    pairs = np.sort((contexts << _16) | ids)
    starts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    pairs, n = pairs[starts], np.diff(np.append(starts, len(pairs)))
    context = (pairs >> _16).astype(np.int64)
    return context, (pairs & 0xFFFF).astype(np.int64), n, np.bincount(contexts, minlength=WHOLE)[context]


def _cells(lists: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, cell of the writer's table) of ids in lists."""
    keys = (lists.astype(np.uint32) << _16) | ids.astype(np.uint32)
    return keys, (keys * _M1) >> np.uint32(32 - FIND_BITS)


def lists_of(ranks: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, ...]:
    """(context, level, entries) of each list, (id, share) of each entry; contexts of order 2 have 2**16 added. Ids are ranks."""
    nothing = tuple(np.empty(0, np.int64) for _ in range(5))
    if len(ranks) < 3:
        return nothing
    wide = ranks.astype(np.uint32)
    c, x, n, of = _followers(wide[:-1], wide[1:])
    keep = (n >= SEEN) & (n * WHOLE > MORE * of * shares[x])
    found = [[a[keep] for a in (c, x, n, of)]]
    c, x, n, of = _followers(_hashed(wide[1:-1], wide[:-2]), wide[2:])
    keep = (n >= SEEN) & (n * 16 > of)
    keep &= (np.bincount(c[keep], n[keep], WHOLE)[c] * 2 > of)
    found.append([a[keep] for a in (c + WHOLE, x, n, of)])
    c, x, n, of = (np.concatenate(a) for a in zip(*found, strict=True))

    def only(keep: np.ndarray) -> None:
        nonlocal c, x, n, of
        c, x, n, of = c[keep], x[keep], n[keep], of[keep]

    mass = np.bincount(c, n, 2 * WHOLE)
    if np.count_nonzero(mass) > LISTS:
        mass[np.argsort(mass, kind="stable")[:-LISTS]] = 0
        only(mass[c] > 0)
    only(n << LIST_BITS >= mass[c])
    number = np.cumsum(np.diff(c, prepend=-1) > 0)
    at, by_times = _cells(number, x)[1], np.argsort(n, kind="stable")
    table = np.zeros(1 << FIND_BITS, np.int64)
    table[at[by_times]] = by_times
    only(table[at] == np.arange(len(at)))
    if not len(c):
        return nothing
    starts = np.flatnonzero(np.diff(c, prepend=-1))
    entries = np.diff(np.append(starts, len(c)))
    mass = np.add.reduceat(n, starts)
    share = np.maximum(1, n * np.repeat((1 << LIST_BITS) - entries, entries) // np.repeat(mass, entries))
    largest = np.lexsort((n, c))[starts + entries - 1]
    share[largest] += (1 << LIST_BITS) - np.add.reduceat(share, starts)
    return c[starts], np.minimum(7, mass * 8 // of[starts]), entries, x, share


class Tables:
    """A file's statistics, as both sides look them up. Entries are first the ids of order 0, then those of the lists.

    Lists are numbered from `_FIRST` on, so that the cells of a list begin at its number
    times its shares, after those of order 0, which count as number 0.
    """

    def __init__(self, shares: np.ndarray, lists: tuple[np.ndarray, ...]):
        context, level, entries, x, share = lists
        n, many = len(shares), len(context)
        number = np.arange(1, many + 1)
        two = context >= WHOLE
        self.one, self.two = np.zeros(max(n, 1), np.uint16), np.zeros(WHOLE, np.uint16)  # lists of order 2 have the larger numbers
        number += _FIRST - 1
        self.one[context[~two]], self.two[context[two] - WHOLE] = number[~two], number[two]
        self.row = np.concatenate((np.zeros(_FIRST, np.int64), 1 + level + 8 * two))
        starts = np.cumsum(entries) - entries
        self.start = np.concatenate((np.zeros(_FIRST, np.int64), n + starts))
        self.cells = np.concatenate((np.repeat(np.arange(n), shares), np.repeat(np.arange(len(x)) - np.repeat(starts, entries), share))).astype(np.uint16)  # an entry's place in its list
        below = np.cumsum(share) - share - np.repeat(np.arange(many) << LIST_BITS, entries)
        facts = np.zeros((n + len(x), 4), np.uint16)  # what is below an entry, what its size has beyond 1, its id
        facts[:n, 0], facts[n:, 0] = np.cumsum(shares) - shares, below
        facts[:n, 1], facts[n:, 1] = shares - 1, share - 1
        facts[:n, 2], facts[n:, 2] = np.arange(n), x
        self.facts = facts.view(np.int64).ravel()
        self.ids, self.entry_list = facts[:, 2], np.repeat(number, entries)

    def finder(self) -> tuple[np.ndarray, np.ndarray]:
        """(entry by cell, key by entry); the key of an entry of order 0 is that of no id in a list."""
        n = len(self.ids) - len(self.entry_list)
        keys, at = _cells(self.entry_list - (_FIRST - 1), self.ids[n:])
        table = np.zeros(1 << FIND_BITS, np.int32)
        table[at] = np.arange(n, len(self.ids))
        return table, np.concatenate((np.full(n, 0xFFFFFFFF, np.uint32), keys))


class _Weights:
    """How often the list held the next id, by block and row."""

    def __init__(self, lanes: int):
        level = np.arange(ROWS - 1) % 8
        self.first = np.tile(np.concatenate(([0], (2 * level + 1 << WHOLE_BITS) // 16)), lanes)
        self.base = np.arange(lanes, dtype=np.int64) * ROWS
        self.held, self.met = np.zeros(lanes * ROWS, np.int64), np.zeros(lanes * ROWS, np.int64)

    def now(self) -> np.ndarray:
        """The list's weight, of `WHOLE`."""
        weight = np.clip((self.first * PRIOR + (self.held << WHOLE_BITS)) // (self.met + PRIOR), FLOOR, WHOLE - FLOOR)
        weight[::ROWS] = 0
        return weight.astype(np.uint16)

    def add(self, rows: np.ndarray, near: np.ndarray) -> None:
        many = len(self.met)
        other, held = np.bincount((rows + near * many).ravel(), minlength=2 * many).reshape(2, many)
        self.met += other + held
        self.held += held

    def settle(self) -> None:
        """Both sides do so at the same places, whatever they add at once."""
        if len(full := np.flatnonzero(self.met > MOST)):
            self.held[full] >>= 1
            self.met[full] >>= 1


def encode_blocks(ranks: np.ndarray, tables: Tables) -> list[bytes]:
    """The code of each block of `ranks` (of the file's distinct ids), for at most `LANES` blocks."""
    lanes = -(-len(ranks) // BLOCK)
    last = len(ranks) - (lanes - 1) * BLOCK
    steps = np.zeros((BLOCK + 2, lanes), np.uint16)
    filled = np.zeros(lanes * BLOCK, np.uint16)
    filled[: len(ranks)] = ranks
    steps[2:] = filled.reshape(lanes, BLOCK).T
    del filled
    width = 2 * BLOCK + 8
    out = np.zeros(width * lanes, np.uint32)  # the blocks' digits side by side: at most times the blocks are at like places
    base = np.arange(lanes, dtype=np.int64)
    at = base.copy()
    low, span = np.zeros(lanes), np.full(lanes, _TOP - 1)
    weights, (find, keys) = _Weights(lanes), tables.finder()

    def shift(of: np.ndarray) -> None:
        place, under = at.take(of, mode="clip"), low.take(of, mode="clip")
        digit = np.floor(under * (1 / _LEAST))
        out[place] = digit.astype(np.uint32)  # cast first: an assignment casts one by one
        at[of] = place + lanes
        low[of] = (under - digit * _LEAST) * _DIGIT

    rows_at_once = max(1, AT_ONCE // lanes)
    for start, stop in zip((0, *PLACES), (*PLACES, BLOCK), strict=True):
        weight = weights.now()
        for first in range(start, stop, rows_at_once):
            end = min(first + rows_at_once, stop)
            now, before = steps[first + 2 : end + 2], steps[first + 1 : end + 1]
            lists = np.maximum(tables.one.take(before, mode="clip"), tables.two.take(_hashed(before, steps[first:end]), mode="clip"))
            rows = tables.row.take(lists, mode="clip") + weights.base
            wanted, cells = _cells(lists - np.uint16(_FIRST - 1), now)  # of no list: a number beyond all
            entries = find.take(cells, mode="clip")
            near = keys.take(entries, mode="clip") == wanted
            np.copyto(entries, now, where=~near)
            own = weight.take(rows, mode="clip")
            weights.add(rows, near)
            far = np.logical_not(near).astype(np.float64)
            wider = _WIDER - (_WIDER - 1) * far
            facts = tables.facts.take(entries, mode="clip").view(np.uint16)
            below, size = facts[:, ::4] * wider, (facts[:, 1::4] + 1.0) * wider
            for t in range(first, end):
                n = lanes if t < last else lanes - 1
                if not n:
                    break
                k = t - first
                part, away, lower, rest = span[:n], far[k, :n], low[:n], size[k, :n]
                unit = np.floor(part * (1 / WHOLE))
                under = unit * own[k, :n]
                unit *= WHOLE
                unit *= away
                unit -= under
                np.abs(unit, out=unit)  # the list's part, or what it leaves
                unit *= 1 / WHOLE
                np.floor(unit, out=unit)
                under *= away
                lower += under
                lower += unit * below[k, :n]
                np.multiply(unit, rest, out=part)
                if lower.max() >= _TOP:
                    over = np.flatnonzero(lower >= _TOP)
                    out[at[over] - lanes] += 1  # the carry; digits may pass 16 bits until the end
                    lower[over] -= _TOP
                small = np.flatnonzero(part < _LEAST)
                while len(small):
                    shift(small)
                    more = part.take(small, mode="clip") * _DIGIT
                    part[small] = more
                    small = small[more < _LEAST]
        weights.settle()
    for _ in range(3):
        shift(base)
    ends = at // lanes
    digits = np.ascontiguousarray(out.reshape(width, lanes)[: ends.max()].T)
    while (digits >> 16).any():
        carry = digits >> 16
        digits &= 0xFFFF
        digits[:, :-1] += carry[:, 1:]
    digits = digits.astype("<u2")
    return [digits[i, :n].tobytes() for i, n in enumerate(ends.tolist())]


@np.errstate(all="ignore")  # numbers of a damaged block may grow beyond all bounds
def decode_blocks(codes: list[bytes], lengths: list[int], tables: Tables) -> np.ndarray:
    """The ranks of blocks' ids, of which the last alone may be shorter than `BLOCK`."""
    lanes, last = len(codes), lengths[-1]
    width = max(map(len, codes)) // 2 + 4
    given = np.zeros((lanes, width), np.uint16)
    for i, c in enumerate(codes):
        given[i, : len(c) // 2] = np.frombuffer(c, "<u2")
    head = given[:, :3].astype(np.float64)
    value = (head[:, 0] * _DIGIT + head[:, 1]) * _DIGIT + head[:, 2]
    digits = given.T.ravel()  # side by side: at most times the blocks are at like places
    del given
    at = np.arange(lanes, dtype=np.int64) + 3 * lanes
    span = np.full(lanes, _TOP - 1)
    weights = _Weights(lanes)
    found = np.zeros((BLOCK, lanes), np.uint16)
    latest, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint32)

    for start, stop in zip((0, *PLACES), (*PLACES, BLOCK), strict=True):
        own = weights.now()
        rows, near = np.tile(weights.base, (stop - start, 1)), np.zeros((stop - start, lanes), bool)
        for t in range(start, stop):
            n = lanes if t < last else lanes - 1
            if not n:
                break
            k = t - start
            rest, part, row, held = value[:n], span[:n], rows[k, :n], near[k, :n]
            wide = latest[:n].astype(np.uint32)
            hashed = wide * _M1
            hashed += before[:n]
            hashed >>= _16
            before = wide * _M2
            lists = np.maximum(tables.one.take(latest[:n], mode="clip"), tables.two.take(hashed, mode="clip")).astype(np.int64)
            row += tables.row.take(lists, mode="clip")
            unit = np.floor(part * (1 / WHOLE))
            under = unit * own.take(row, mode="clip")
            np.less(rest, under, out=held)
            away = np.logical_not(held).astype(np.float64)
            unit *= WHOLE
            unit *= away
            unit -= under
            np.abs(unit, out=unit)  # the list's part, or what it leaves
            unit *= 1 / WHOLE
            np.floor(unit, out=unit)
            under *= away
            rest -= under
            away *= 1 - _WIDER
            away += _WIDER
            unit *= away
            lists *= held
            # a damaged block must not read beyond the tables, nor beyond the digits: indexes are clipped
            entry = tables.start.take(lists, mode="clip")
            lists <<= LIST_BITS
            lists += (rest / unit).astype(np.int64)
            entry += tables.cells.take(lists, mode="clip")
            facts = tables.facts.take(entry, mode="clip").view(np.uint16)
            rest -= unit * facts[::4]
            np.multiply(unit, facts[1::4], out=part)
            part += unit
            small = part < _LEAST
            away = small.astype(np.float64)
            more = rest * (_DIGIT - 1)
            more += digits.take(at[:n], mode="clip")
            more *= away
            rest += more
            away *= _DIGIT - 1
            away += 1
            part *= away
            at[:n] += np.multiply(small, lanes)
            if part.min() < _LEAST:
                again = np.flatnonzero(part < _LEAST)
                here = at.take(again)
                value[again] = value.take(again) * _DIGIT + digits.take(here, mode="clip")
                span[again] *= _DIGIT
                at[again] = here + lanes
            found[t, :n] = facts[2::4]
            latest = found[t].astype(np.int64)
        weights.add(rows, near)
        weights.settle()
    return np.ascontiguousarray(found.T).ravel()[: (lanes - 1) * BLOCK + last]


def _checksums(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)], "<u4")


def _packed(lists: tuple[np.ndarray, ...]) -> bytes:
    return zlib.compress(np.array([len(lists[0]), len(lists[3])], "<u4").tobytes() + b"".join(a.astype("<u4" if a is lists[0] else "<u2").tobytes() for a in lists))


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    raw = zlib.decompress(data)
    many, entries = np.frombuffer(raw, "<u4", 2).tolist()
    found, at = [], 8
    for n, kind in ((many, "<u4"), (many, "<u2"), (many, "<u2"), (entries, "<u2"), (entries, "<u2")):
        found.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
        at += n * int(kind[-1])
    return tuple(found)


def write_image(keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of some documents' ids in order; `lengths` are the ids of each document."""
    distinct, shares = counts_of(ids)
    rank = np.zeros(1 << 16, np.uint16)
    rank[distinct] = np.arange(len(distinct))
    ranks = rank[ids]
    lists = lists_of(ranks, shares)
    tables = Tables(shares, lists)
    blocks = [b for i in range(0, len(ids), LANES * BLOCK) for b in encode_blocks(ranks[i : i + LANES * BLOCK], tables)]
    sink = pa.BufferOutputStream()
    index = pa.RecordBatch.from_arrays([keys, pa.array(lengths, pa.int64())], ["key", "n"])
    with pa.ipc.new_stream(sink, index.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(index)
    parts = [sink.getvalue().to_pybytes(), zlib.compress(distinct.astype("<u2").tobytes() + (shares - 1).astype("<u2").tobytes()), _packed(lists), np.array([len(b) for b in blocks], "<u4").tobytes() + _checksums(ids).tobytes()]
    header = json.dumps({"ids": len(ids), "documents": len(lengths), "block": BLOCK, "index": len(parts[0]), "counts": len(parts[1]), "lists": len(parts[2]), "directory": len(parts[3])}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *parts, *blocks])


class Image:
    """A file image: its documents, and its ids by block or whole."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        at = len(MAGIC) + 4
        size = int.from_bytes(data[at - 4 : at], "little")
        self.header = json.loads(data[at : at + size])
        if self.header["block"] != BLOCK:
            raise ValueError(f"blocks of {self.header['block']} ids, not {BLOCK}")
        parts, at = [], at + size
        for name in ("index", "counts", "lists", "directory"):
            parts.append(data[at : at + self.header[name]])
            at += self.header[name]
        with pa.ipc.open_stream(parts[0]) as stream:
            index = stream.read_all().combine_chunks()
        self.keys, self.lengths = index.column("key"), index.column("n").to_numpy()
        self.distinct, shares = np.frombuffer(zlib.decompress(parts[1]), "<u2").reshape(2, -1)
        self.tables = Tables(shares.astype(np.int64) + 1, _unpacked(parts[2]))
        sizes, self.sums = np.frombuffer(parts[3], "<u4").reshape(2, -1)
        self.ends = at + np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
        self.data = data

    def blocks(self, first: int, stop: int) -> np.ndarray:
        """The ids of some blocks, which need no others; damage is an error."""
        codes = [self.data[self.ends[i] : self.ends[i + 1]] for i in range(first, stop)]
        lengths = [min(BLOCK, self.header["ids"] - i * BLOCK) for i in range(first, stop)]
        ids = self.distinct[decode_blocks(codes, lengths, self.tables)]
        for i, found in enumerate(_checksums(ids).tolist(), first):
            if found != self.sums[i]:
                raise ValueError(f"block {i} is damaged")
        return ids

    def ids(self) -> np.ndarray:
        many = len(self.sums)
        return np.concatenate([np.empty(0, np.uint16), *(self.blocks(i, min(many, i + LANES)) for i in range(0, many, LANES))])


FILES = "part int, nth int, documents long, ids long, data binary"


def file_images(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(part, nth, documents, ids, data): the documents' ids in files, in ascending order of doc_id, part and nth.

    A null text is empty; each document ends with `end_id`. Null ids come first; rows of
    one id are ordered by a hash of their texts, and may be dealt to several parts. The
    vocabulary has at most 65,536 ids.
    """
    path = path or vocabulary_path()
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    names = ["doc_id", "hash", "row"]
    given = docs.select("doc_id", "text").select("doc_id", order[1].alias("hash"), order[2].alias("row"), "text")
    dealt = given.repartitionByRange(*names).sortWithinPartitions(*names).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        if encoder.wide:
            raise ValueError("ids of more than 16 bits")
        part, nth, held = TaskContext.get().partitionId(), 0, 0
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        end = np.array([end_id], np.uint16)

        def send() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in ids], np.int64)
            image = write_image(pa.concat_arrays(keys), lengths, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([len(lengths)]), pa.array([int(lengths.sum())]), pa.array([image], pa.binary())], ["part", "nth", "documents", "ids", "data"])

        for batch in slices(batches):
            first = 0
            for i, got in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids.append(np.concatenate((got, end)))
                held += len(ids[-1])
                if held >= FILE_IDS:
                    keys.append(batch.column(0).slice(first, i + 1 - first))
                    yield send()
                    keys, ids, held, nth, first = [], [], 0, nth + 1, i + 1
            if first < batch.num_rows:
                keys.append(batch.column(0).slice(first))
        if ids:
            yield send()

    return dealt.mapInArrow(run, FILES)


def write_files(docs: DataFrame, where: str, path: str | None = None) -> None:
    """Write the documents' ids as a table of file images."""
    file_images(docs, path).write.option("compression", "uncompressed").mode("errorifexists").parquet(where)


def read_documents(files: DataFrame, key_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document as read from its file, and on request `ids`."""
    fields = [("doc_id", None), ("part", pa.int32()), ("nth", pa.int32()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, nth, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                image = Image(data)
                ids, ends = image.ids(), np.cumsum(image.lengths)
                starts = ends - image.lengths
                for first in range(0, len(ends), 10_000):
                    some = slice(first, first + 10_000)
                    wide = [ids[a:b].astype("<u4") for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                    n = len(wide)
                    keys = image.keys.slice(first, n)
                    columns = [keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys, pa.array([part] * n, pa.int32()), pa.array([nth] * n, pa.int32()), pa.array(starts[some]), pa.array(image.lengths[some]), pa.array([zlib.crc32(w.tobytes()) for w in wide], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(wide, pa.list_(pa.int32()))] * with_ids, [n for n, _ in fields])

    found = files.select("part", "nth", "data").mapInArrow(run, f"doc_id {key_type}, part int, nth int, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    # one number for each file meets in one task: a file holds `FILE_IDS` ids or a whole document
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.materialize(files.select("part", "nth", "ids").select("part", "nth", before.alias("before")), "starts")
    return found.join(starts, ["part", "nth"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids))


def through_files(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write the documents' ids and read them back: a row for each row of `docs`.

    Repeated rows are written as often as they come; other columns are left out, so no
    name clashes; an empty table has one part without files and gives no rows.
    """
    spark = docs.sparkSession
    where = scratch.fresh_path(spark, "token-files")
    write_files(docs, where, path)
    files = spark.read.schema(FILES).parquet(where)
    return read_documents(files, docs.schema["doc_id"].dataType.simpleString(), with_ids)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op12_token_files": op12_token_files}
