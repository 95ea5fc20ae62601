"""Near-duplicate join: exact Jaccard links between shingle sets by PartEnum signatures.

Sets of like size share a band. In a band the domain of shingles is cut by hash into
partitions, and each of these into three second-level partitions. From a partition a set
enumerates the subsets of two of its three second-level partitions: a signature is the
set's contents in both. Sets of Jaccard similarity 0.75 differ in so few shingles that
they must agree in so many subsets: a partition without a difference gives three equal
signatures, one with a single difference still gives one. Very frequent shingles are
left out of the domain, which can only lessen the differences, and keeps passages
common to many documents out of the signatures. A set enumerates partitions in one
order that all sets share, until those that must agree with any partner and are not
empty reach the surplus. A set that does not get there with all of its partitions - a small one, or
one that consists of frequent shingles - also has its single shingles as signatures, as many as a
partner may lack and the surplus, the frequent ones last; two such sets meet by these.

Sets that share enough signatures are candidates. They are not paired all with all:
each set goes to the cluster of the head with which it shares most signatures. In a
cluster, cut into blocks of bounded size, sets of different components are compared and
linked sets become one component at once; then buckets give the pairs of different
clusters and components, until none is left that was not compared. An upper bound on
the intersection (from counts of shingles by hash range) and then the exact
intersection decide each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.llm.components import connected
from loomspan.llm.text import mix, shingle_hashes, slices, trim, utf8

WORDS = 5
#: Links have 7 * intersection >= 3 * (sum of sizes), which is a Jaccard similarity of 0.75 or more.
#: From this band (exponent of its least size) on, sets enumerate subsets of partitions; smaller ones have single shingles alone.
SUBSETS = 4
#: Very frequent shingles: at least so many documents, at most so many shingles. Fewer of them cost time, not links.
FREQUENT, FREQUENT_MOST = 300, 100_000
#: Bytes that a written table may have to be broadcast; larger ones are joined by shuffles.
BROADCAST_BYTES = 16 << 20
#: Rows from which on a bucket's rows are not brought together to choose its head.
LARGE = 256
#: Bytes of shingles in a block of a cluster.
BLOCK = 4 << 20
#: Rows of tokens that a task sorts in memory: inputs of any size are dealt into as many shares as they need.
SHARE = 4_000_000
#: Bytes of rows of buckets that a task compares in memory; pairs that it makes at once, and bytes of sketches compared at once.
CROSS, PAIRS, TILE = 64 << 20, 1 << 18, 8 << 20
#: Largest bitmap of candidates, in bits.
BITMAP = 1 << 27


def linked(a: int, b: int, both: int) -> bool:
    return both > 0 and 7 * both >= 3 * (a + b)


def small(table: DataFrame) -> DataFrame:
    """The written table of numbers, to be broadcast if its rows and columns allow; one with other columns is not."""
    if any(f.dataType.simpleString() not in ("bigint", "int") for f in table.schema):
        return table
    return F.broadcast(table) if table.count() * (16 + 8 * len(table.columns)) <= BROADCAST_BYTES else table


def set_ids(h: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set of hashes, as signed numbers."""
    with np.errstate(over="ignore"):
        one = mix(h ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(h))
        two = mix(h + np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
        return int(mix(np.array([one]))[0].astype(np.int64)), int(two.astype(np.int64))


def sketch(h: np.ndarray) -> bytes:
    """Counts of the hashes by their leading bits, about four to a range, as bytes."""
    bits = max(4, int(len(h) // 4).bit_length())
    while True:
        counts = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max(initial=0) < 256:
            return counts.astype(np.uint8).tobytes()
        bits += 1


def at_most(a: bytes, b: bytes) -> int:
    """An upper bound on the intersection of two sets from their sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = y.reshape(len(x), -1).sum(1)
    return int(np.minimum(x, y).sum())


def bands(size: int) -> list[int]:
    """Bands (exponents of their least size) in which a set takes part: its own, and the next if a partner can be there."""
    own = size.bit_length() - 1
    return [own, own + 1] if 4 * size >= 3 << (own + 1) else [own]


def differences(size: int, band: int) -> int:
    """How many shingles a set and a partner of the band can at most have apart, on both sides together."""
    return (size + min((2 << band) - 1, 4 * size // 3)) // 7


def missing(size: int, band: int) -> int:
    """How many of a set's shingles a partner of the band can at most lack."""
    least = max(-(-3 * size // 4), 1 << band if band >= size.bit_length() else 0)
    return size + (-3 * (size + least) // 7)


def surplus(band: int) -> int:
    """How many signatures a linked pair of the band shares at least: sets enumerate so many beyond the possible differences."""
    return 1 if band < 3 else 2 if band < 4 else 4 if band < 5 else 6 if band < 7 else 16


def partitions(band: int) -> int:
    """First-level partitions of a band: enough for the largest set, and an eighth more for empty subsets."""
    return (2 * ((2 << band) - 1) // 7 + surplus(band)) * 9 // 16 + 2


def subsets(h: np.ndarray, size: int, band: int) -> tuple[np.ndarray, bool]:
    """Signatures of the subsets of two of three second-level partitions, and whether they reach the surplus with every partner.

    h: the set's shingles without the frequent ones, sorted; size: that of the whole set. Over n partitions with d
    differences at least 2n - d subsets agree, since a partition gives three without a difference, one with one, and
    less than none is never counted; the set's own empty subsets are taken off.
    """
    n = partitions(band)
    at = ((h >> np.uint64(32)) * np.uint64(3 * n)) >> np.uint64(32)
    content, held = np.zeros(3 * n, np.uint64), np.zeros(3 * n, bool)
    with np.errstate(over="ignore"):
        if len(h):
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            content[at[starts]] = np.add.reduceat(mix(h ^ np.uint64(band + 1)), starts)
            held[at[starts]] = True
        content, held = content.reshape(n, 3), held.reshape(n, 3)
        place = np.arange(3 * n, dtype=np.uint64).reshape(n, 3) + np.uint64(band << 40)
        made = mix(content.sum(1, dtype=np.uint64)[:, None] - content + mix(place))  # each leaves one of the three out
    full = np.stack([held[:, 1] | held[:, 2], held[:, 0] | held[:, 2], held[:, 0] | held[:, 1]], axis=1)
    sure = 2 * np.arange(1, n + 1) - differences(size, band) - np.cumsum(3 - full.sum(1)) >= surplus(band)
    strong = bool(sure.any())
    used = int(np.argmax(sure)) + 1 if strong else n
    return made[:used][full[:used]], strong


def singles(h: np.ndarray, often: np.ndarray, band: int) -> np.ndarray:
    """Single shingles as signatures: as many as a partner of the band may lack and the surplus, the frequent ones last."""
    seed = np.uint64((band * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    n = missing(len(h), band) + surplus(band)
    plain = h[~often]
    with np.errstate(over="ignore"):
        return mix((plain[:n] if len(plain) >= n else np.concatenate((plain, h[often][: n - len(plain)]))) + seed)


def signatures(h: np.ndarray, frequent: np.ndarray | None = None) -> np.ndarray:
    """All signatures that a set enumerates."""
    often = np.zeros(len(h), bool)
    if frequent is not None and len(frequent):
        at = np.searchsorted(frequent, h)
        at[at == len(frequent)] = 0
        often = frequent[at] == h
    out = []
    for band in bands(len(h)):
        strong = False
        if band >= SUBSETS:
            made, strong = subsets(h[~often], len(h), band)
            out.append(made)
        if not strong:
            out.append(singles(h, often, band))
    return np.concatenate(out)


def profiles(docs: DataFrame) -> DataFrame:
    """A row for each document (size, digests, sketch), and rows that count frequent shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=16 << 20):
            sets = [shingle_hashes(t, WORDS) for t in utf8(batch.column(1))]
            ids = [set_ids(h) if len(h) else (None, None) for h in sets]
            n = batch.num_rows
            distinct = {i: h for i, h in zip(ids, sets, strict=True) if len(h)}
            value, count = np.unique(np.concatenate(list(distinct.values())), return_counts=True) if distinct else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = count >= 3
            m = int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0).cast(batch.schema.field(0).type), pa.nulls(m, batch.schema.field(0).type)]),
                    pa.array([0] * n + [1] * m, pa.int32()),
                    pa.array([len(h) for h in sets] + count[often].tolist(), pa.int64()),
                    pa.array([i for i, _ in ids] + value[often].view(np.int64).tolist(), pa.int64()),
                    pa.array([c for _, c in ids] + [None] * m, pa.int64()),
                    pa.array([sketch(h) if len(h) else None for h in sets] + [None] * m, pa.binary()),
                ],
                ["doc_id", "kind", "n", "sid", "check", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, kind int, n long, sid long, check long, sketch binary")


def signature_rows(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(token, sid), each set once for each task."""
    spark = docs.sparkSession
    handle = spark.sparkContext.broadcast(frequent)  # at most FREQUENT_MOST numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, most=4 << 20):
            tokens, owners = [], []
            for text in utf8(batch.column(0)):
                h = shingle_hashes(text, WORDS)
                if not len(h):
                    continue
                sid = set_ids(h)[0]
                if sid in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sid)
                made = signatures(h, handle.value)
                tokens.append(made)
                owners.append(np.full(len(made), sid, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners))], ["token", "sid"])

    return docs.select("text").mapInArrow(run, "token long, sid long")


def dealt(rows: DataFrame, count: int, share: int) -> DataFrame:
    """The rows by token in shares of at most about so many, of `count` in all: the number of shares follows the input, not a setting."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // share)), "token")


def shared(rows: DataFrame, count: int) -> DataFrame:
    """Rows (token, sid) of the tokens that at least two different sets have, each row once; `count`: how many rows there are at most.

    Each task sorts its share of the tokens, which has a bounded number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            tokens.append(batch.column(0).to_numpy())
            sids.append(batch.column(1).to_numpy())
        token, sid = np.concatenate(tokens), np.concatenate(sids)
        del tokens, sids
        order = np.argsort(token, kind="stable")
        token, sid = token[order], sid[order]
        many = np.zeros(len(token), bool)
        same = token[1:] == token[:-1]
        many[1:] |= same
        many[:-1] |= same
        token, sid = token[many], sid[many]
        order = np.lexsort((sid, token))
        token, sid = token[order], sid[order]
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
        token, sid = token[once], sid[once]
        many = np.zeros(len(token), bool)
        same = token[1:] == token[:-1]
        many[1:] |= same
        many[:-1] |= same
        yield pa.RecordBatch.from_arrays([pa.array(token[many]), pa.array(sid[many])], ["token", "sid"])
        trim()

    return dealt(rows.select("token", "sid"), count, SHARE).mapInArrow(run, "token long, sid long")


def prune(buckets: DataFrame, sizes: DataFrame, rounds: int = 1) -> DataFrame:
    """Rows of the sets that share as many signatures with others as a linked set must."""
    need = F.when(F.col("n") < 8, surplus(0))
    for band in range(3, 8):
        need = need.when(F.col("n") < 2 << band, surplus(band))
    need = need.otherwise(surplus(8))
    for _ in range(rounds):
        enough = buckets.groupBy("sid").agg(F.count("*").alias("c")).join(sizes, "sid").where(F.col("c") >= need).select("sid")
        enough = scratch.materialize(enough, "enough")
        buckets = scratch.materialize(shared(buckets.join(small(enough), "sid"), buckets.count()), "buckets")
    return buckets


def candidate_sets(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(sid, shingles) of the candidates (sid, rep): the representatives' texts are read again, told apart by a bitmap of bounded size."""
    bits = min(BITMAP, 1 << max(16, (16 * candidates.count()).bit_length()))
    at = F.xxhash64("rep").bitwiseAND(F.lit(bits - 1))
    words = candidates.select(at.alias("i")).groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("b")).toArrow()
    bitmap = np.zeros(bits >> 6, np.uint64)
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    handle = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy() & (bits - 1)
            there = (handle.value[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            for part in slices(iter([batch.filter(pa.array(there == 1))]), most=4 << 20):
                sids, sets = [], []
                for text in utf8(part.column(1)):
                    h = shingle_hashes(text, WORDS)
                    if len(h):
                        sids.append(set_ids(h)[0])
                        sets.append(h.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], ["sid", "h"])

    found = docs.select(F.xxhash64("doc_id").alias("k"), "text").mapInArrow(run, "sid long, h binary")
    return found.join(candidates.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked pairs (a, b) among candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                keep.append(linked(len(x), len(y), int((y[at] == x).sum())))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    one = sets.select(F.col("sid").alias("a"), F.col("h").alias("x")).join(small(pairs), "a")
    two = sets.select(F.col("sid").alias("b"), F.col("h").alias("y")).join(small(pairs), "b")
    both = one.join(two, ["a", "b"])
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _bucket_edges(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
    return edges[:-1], edges[1:]


def _gathered(batches: Iterator[pa.RecordBatch], columns: int) -> np.ndarray:
    table = [np.stack([b.column(i).to_numpy() for i in range(columns)]) for b in batches]
    return np.concatenate(table, axis=1) if table else np.empty((columns, 0), np.int64)


def best_heads(buckets: DataFrame, sized: DataFrame) -> DataFrame:
    """(sid, head): for each set one head of its buckets, of a size that allows a link: the one with which it shares most.

    sized: sid, n, rank. A bucket's head is its set of highest rank, the share of the
    set's signatures that others have too: the text of which the others are copies. Of
    larger sets a quarter of the buckets votes. Heads only say where pairs are looked
    for first; pairs of different clusters are compared by all of their buckets later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, sid, n, rank = _gathered(batches, 4)
        order = np.lexsort((sid, rank, token))
        token, sid, n = token[order], sid[order], n[order]
        starts, ends = _bucket_edges(token) if len(token) else (np.empty(0, int), np.empty(0, int))
        top = np.repeat(ends - 1, ends - starts)
        fits = (sid != sid[top]) & (4 * np.minimum(n, n[top]) >= 3 * np.maximum(n, n[top])) if len(token) else np.empty(0, bool)
        pair = np.stack([sid[fits], sid[top][fits]]) if len(token) else np.empty((2, 0), np.int64)
        order = np.lexsort(pair)
        pair = pair[:, order]
        first = np.flatnonzero(np.concatenate(([True], (pair[:, 1:] != pair[:, :-1]).any(0)))) if pair.shape[1] else np.empty(0, int)
        count = np.diff(np.append(first, pair.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array(pair[0, first]), pa.array(pair[1, first]), pa.array(count, pa.int64())], ["sid", "b", "c"])
        trim()

    voting = buckets.join(small(sized), "sid").where("n < 96 OR token & 3 = 0").select("token", "sid", "n", "rank")
    voting = scratch.materialize(voting, "voting")
    # large buckets' heads are found by partial sums and sent to their rows, wherever these are; only the others are brought together
    top = voting.groupBy("token").agg(F.count("*").alias("rows"), F.max(F.struct("rank", "sid", "n")).alias("top")).where(F.col("rows") > LARGE)
    top = scratch.materialize(top.select("token", F.col("top.sid").alias("b"), F.col("top.n").alias("most")), "large")
    fits = (F.col("sid") != F.col("b")) & (4 * F.least("n", "most") >= 3 * F.greatest("n", "most"))
    large = voting.join(small(top), "token").where(fits).select("sid", "b", F.lit(1).cast("long").alias("c"))
    rest = voting.join(small(top.select("token")), "token", "left_anti")
    pairs = dealt(rest, voting.count(), SHARE // 4).mapInArrow(run, "sid long, b long, c long").unionByName(large)
    pairs = pairs.groupBy("sid", "b").agg(F.sum("c").alias("c"))
    return pairs.groupBy("sid").agg(F.max_by("b", F.struct("c", "b")).alias("head"))


def _links_within(table: pa.Table) -> pa.Table:
    """Links (a, b) that join what was not joined, among the sets of one block or of two."""
    sid = table.column("sid").to_numpy()
    order = np.lexsort((sid, -table.column("rank").to_numpy()))
    h = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("h")]
    sid, h = sid[order], [h[i] for i in order]
    side = table.column("block").to_numpy()[order]
    comp = np.unique(table.column("comp").to_numpy()[order], return_inverse=True)[1]
    two = len(set(side.tolist())) > 1
    n = np.array([len(x) for x in h])
    bits = min(10, max(4, int(n.max()).bit_length()))
    counts = np.stack([np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) for x in h])
    counts = np.minimum(counts, 65535).astype(np.uint16) if n.max() < 65536 else counts
    out: list[tuple[int, int]] = []
    for i in range(len(h)):
        later = np.arange(i + 1, len(h))
        later = later[(comp[later] != comp[i]) & (4 * np.minimum(n[later], n[i]) >= 3 * np.maximum(n[later], n[i]))]
        if two:
            later = later[side[later] != side[i]]  # a block's own pairs are another group's
        for part in (later[k : k + 512] for k in range(0, len(later), 512)):
            bound = np.minimum(counts[part], counts[i]).sum(1, dtype=np.int64)
            for j in part[7 * bound >= 3 * (n[part] + n[i])].tolist():
                if comp[j] == comp[i]:
                    continue
                at = np.searchsorted(h[i], h[j])
                at[at == len(h[i])] = 0
                if linked(len(h[i]), len(h[j]), int((h[i][at] == h[j]).sum())):
                    out.append((int(sid[i]), int(sid[j])))
                    comp[comp == comp[j]] = comp[i]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def cluster_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within clusters that join different components; with them a cluster's linked sets are connected.

    members: sid, n, rank, comp, head (the cluster). A cluster beyond a block's size is
    cut into blocks by hash, and every two of them meet in a group of their own.
    """
    blocks = members.groupBy("head").agg(F.ceil(F.sum(8 * F.col("n")) / BLOCK).cast("int").alias("blocks"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    rows = members.join(blocks.where("low <> high").drop("low", "high"), "head").withColumn("block", F.expr("cast(pmod(xxhash64(sid), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("head", "sid", "rank", "comp", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = scratch.materialize(rows, "blocks")
    return sets.join(small(rows), "sid").groupBy("head", "low", "high").applyInArrow(_links_within, "a long, b long")


def mixed_rows(rows: DataFrame) -> DataFrame:
    """Rows (token, sid, n, comp, head) of the buckets that hold several components and several clusters, told by partial sums."""
    rows = scratch.materialize(rows.select("token", "sid", "n", "comp", "head"), "members")
    ends = rows.groupBy("token").agg(*(f(x).alias(f"{f.__name__}_{x}") for x in ("comp", "head") for f in (F.min, F.max)))
    mixed = scratch.materialize(ends.where("min_comp <> max_comp AND min_head <> max_head").select("token"), "mixed")
    return rows.join(small(mixed), "token", "left_semi")


def row_bytes() -> Column:
    """Bytes that a row of `cross_pairs` takes at most: five numbers and the sketch of a set of n shingles."""
    return F.greatest(F.lit(16), F.col("n")) + 40


def _meeting(token: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two rows of one bucket but different components, each pair of rows once, about PAIRS at a time; rows are sorted by token and component."""
    starts, ends = _bucket_edges(token)
    end = np.repeat(ends, ends - starts)
    runs = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (comp[1:] != comp[:-1]), [True])))
    after = np.repeat(runs[1:], np.diff(runs))  # a row's partners are those of its bucket that follow its component
    count = end - after
    before = np.concatenate(([0], np.cumsum(count)))
    at = 0
    while at < len(token):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, side="right")) - 1)
        left = np.repeat(np.arange(at, to), count[at:to])
        yield left, after[left] + np.arange(len(left)) - (before[left] - before[at])
        at = to


def _bounded(sketches: list[np.ndarray], kind: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`at_most` of many pairs of sets at once; the sketch of set i is row `place[i]` of `sketches[kind[i]]`, and longer kinds come later."""
    x, y = np.where(kind[x] <= kind[y], (x, y), (y, x))
    most = np.zeros(len(x), np.int64)
    both = kind[x] * len(sketches) + kind[y]
    for value in np.unique(both):
        one, two = sketches[value // len(sketches)], sketches[value % len(sketches)]
        wanted = np.flatnonzero(both == value)
        step = max(1, TILE // two.shape[1])
        for part in (wanted[k : k + step] for k in range(0, len(wanted), step)):
            a, b = one[place[x[part]]], two[place[y[part]]]
            if a.shape[1] < b.shape[1]:
                b = b.reshape(len(part), a.shape[1], -1).sum(2, dtype=np.int64)
            most[part] = np.minimum(a, b).sum(1, dtype=np.int64)
    return most


def cross_pairs(rows: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) of one bucket but different components and clusters whose sizes and sketches allow a link.

    rows: token, sid, n, comp, head, sketch, of `size` bytes in all (`row_bytes`). Each task
    sorts its share of the buckets, and makes and compares a bounded number of pairs at a
    time, so its memory follows the rows and not the pairs; a pair may be given repeatedly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([(c, pa.int64()) for c in ("token", "sid", "n", "comp", "head")] + [("sketch", pa.binary())]))
        token, sid, n, comp, head = (table.column(i).to_numpy() for i in range(5))
        sids, first, known = np.unique(sid, return_index=True, return_inverse=True)
        held = table.column(5).combine_chunks().take(pa.array(first))  # one for each set
        del table
        length, kind = np.unique(np.array([len(x.as_buffer()) for x in held], np.int64), return_inverse=True)
        place = np.empty(len(sids), np.int64)
        sketches = []
        for k in range(len(length)):
            of = np.flatnonzero(kind == k)
            place[of] = np.arange(len(of))
            sketches.append(np.frombuffer(b"".join(held.take(pa.array(of)).to_pylist()), np.uint8).reshape(len(of), -1))
        del held
        order = np.lexsort((comp, token))
        token, n, comp, head, known = token[order], n[order], comp[order], head[order], known[order]
        for i, j in _meeting(token, comp) if len(token) else ():
            keep = (head[i] != head[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
            i, j = i[keep], j[keep]
            pair, at = np.unique(np.minimum(known[i], known[j]) * len(sids) + np.maximum(known[i], known[j]), return_index=True)
            one, two = pair // len(sids), pair % len(sids)
            keep = 7 * _bounded(sketches, kind, place, one, two) >= 3 * (n[i] + n[j])[at]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(sids[one[keep]]), pa.array(sids[two[keep]])], ["a", "b"])
        trim()

    return dealt(rows.select("token", "sid", "n", "comp", "head", "sketch"), size, CROSS).mapInArrow(run, "a long, b long")


def _with_heads(members: DataFrame) -> DataFrame:
    """Every head is a member of its own cluster too, besides the cluster of its own head."""
    heads = members.select("head").distinct().join(members.drop("head").withColumn("head", F.col("sid")), "head")
    return members.unionByName(heads.select(members.columns)).distinct()


def _with_components(members: DataFrame, comps: DataFrame, rename: bool = True) -> DataFrame:
    """Members with their component; with `rename`, clusters are named by the component of their head."""
    of = comps.select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    out = members.join(of, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    if rename:
        heads = comps.select(F.col("node").alias("head"), F.col("component").alias("lead"))
        out = out.join(heads, "head", "left").withColumn("head", F.coalesce("lead", "head"))
    return out.select("sid", "n", "rank", "comp", "head")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= 75 * union of their sets of 5-word
    shingles; component_id is the least doc_id that links reach. A text of fewer words is
    one shingle; one without words, or null, has none and is its own component. Repeated
    rows give repeated rows, with one component. A null doc_id is less than no number,
    so a component has a null id only if all its rows do. Other columns are left out.

    Sets are known by 64-bit digests; a second digest is compared for every document, so
    a collision is an error and not a wrong link.
    """
    profile = scratch.materialize(profiles(docs), "profiles")
    often = profile.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("c")).where(F.col("c") >= FREQUENT)
    often = often.orderBy(F.desc("c"), "sid").limit(FREQUENT_MOST).select("sid").toArrow().column("sid").to_numpy()
    frequent = np.sort(often.astype(np.int64).view(np.uint64))
    rows = profile.where("kind = 0")
    classes = rows.where("n > 0").groupBy("sid").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("check").alias("low"), F.max("check").alias("high")
    )
    classes = scratch.materialize(classes, "classes")
    if not classes.where("low <> high").isEmpty():
        raise RuntimeError("two shingle sets share a digest")
    most = 2 * (rows.agg(F.sum("n").alias("n")).first().n or 0)  # a set has fewer than twice as many signatures as shingles, small ones aside
    buckets = scratch.materialize(shared(signature_rows(docs, frequent), most), "buckets")
    sizes = classes.select("sid", "n")
    buckets = prune(buckets, sizes)
    degrees = buckets.groupBy("sid").agg(F.count("*").alias("c"))
    sized = scratch.materialize(degrees.join(classes, "sid").select("sid", "rep", "n", F.expr("c * 1000000 div n").alias("rank")), "sized")
    sets = scratch.materialize(candidate_sets(docs, sized.select("sid", "rep")), "sets", "none")
    sized = sized.drop("rep")
    sized = scratch.materialize(sized.join(best_heads(buckets, sized), "sid", "left").withColumn("head", F.coalesce("head", "sid")), "sized")
    links = scratch.materialize(cluster_links(_with_heads(sized.withColumn("comp", F.col("sid"))), sets), "links")
    # once more where heads turned out to be linked: one cluster for each component of heads
    member = scratch.materialize(_with_components(sized, connected(links)), "members")
    links = links.unionByName(scratch.materialize(cluster_links(member, sets), "links"))
    comps = connected(links)
    # clusters keep the names under which the second pass compared them: sets of two clusters have not met, even if their heads are linked by now
    member = _with_components(member.drop("comp"), comps, rename=False)
    mixed = scratch.materialize(mixed_rows(buckets.join(small(scratch.materialize(member, "members")), "sid")), "mixed")
    size = mixed.agg(F.sum(row_bytes()).alias("n")).first().n or 0
    pairs = scratch.materialize(cross_pairs(mixed.join(classes.select("sid", "sketch"), "sid"), size).distinct(), "pairs")
    found = scratch.materialize(verify(pairs, sets), "found")
    if not found.isEmpty():
        comps = connected(links.unionByName(found))
    named = classes.select("sid", "rep").join(comps.select(F.col("node").alias("sid"), "component"), "sid")
    heads = named.groupBy("component").agg(F.min("rep").alias("head"))
    named = named.join(heads, "component").select("sid", "head")
    whole = classes.select("sid", "rep").join(named, "sid", "left").select("sid", F.coalesce("head", "rep").alias("head"))
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = rows.where("n > 0").join(whole, "sid").select("doc_id", F.col("n").alias("n_shingles"), F.col("head").alias("component_id"))
    return full.unionByName(empty)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near duplicates, with all its columns; rows without words are all kept.

    The row of the least doc_id stays (a null id is greater than all), and of rows with
    one id any one. Rows are numbered in a written copy, since ids may be shared or null;
    after the join only numbers and ids are shuffled, and texts only if the numbers of
    the copies are too many to broadcast.
    """
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    keyed = scratch.materialize(docs.select(F.monotonically_increasing_id().alias("key"), row), "numbered")
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    found = scratch.materialize(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")), "components")
    several = found.where("key <> component")
    several = several.unionByName(several.select(F.col("component").alias("key"), "component").distinct())
    ids = keyed.select("key", F.col("row.doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    several = scratch.materialize(several.join(ids, "key").select("component", order.alias("order")), "several")
    heads = several.groupBy("component").agg(F.min("order").alias("head"))
    gone = several.join(heads, "component").where(F.col("order.key") != F.col("head.key")).select(F.col("order.key").alias("key"))
    gone = scratch.materialize(gone, "gone")
    return keyed.join(small(gone), "key", "left_anti").select("row.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+'), [])"


def components_sql(documents: str = "documents") -> str:
    """CTEs ending in `comp` (doc_id, n_shingles, component_id) over a table or subquery of documents with distinct ids."""
    return rf"""
    w AS (SELECT doc_id, {_WORDS} AS w FROM {documents}),
    g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM w WHERE len(w) > 0)),
    z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    df AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
    gg AS (SELECT g.* FROM g JOIN df USING (s)),
    j AS (SELECT a.doc_id AS a, b.doc_id AS b FROM gg a JOIN gg b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
        HAVING 100 * count(*) >= 75 * ((SELECT n FROM z WHERE z.doc_id = a.doc_id) + (SELECT n FROM z WHERE z.doc_id = b.doc_id) - count(*))),
    e AS (SELECT a, b FROM j UNION SELECT b, a FROM j),
    reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
    comp AS (SELECT w.doc_id AS doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
        FROM w LEFT JOIN z USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = w.doc_id)"""


SQL = {"op8_jaccard_join": f"WITH RECURSIVE {components_sql()} SELECT doc_id, n_shingles, component_id FROM comp"}
QUERIES = {"op8_jaccard_join": op8_jaccard_join}
