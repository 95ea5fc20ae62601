"""Exact integer clustering and the source divergence audit against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loomspan.llm import centroids, divergence

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [centroids, divergence])
def test_equals_sql(spark, module):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, query in module.QUERIES.items():
        got, want = query(spark, SF).toPandas(), con.execute(module.SQL[name]).df()
        names = sorted(want.columns)
        assert sorted(got.columns) == names
        assert sorted(map(repr, got[names].itertuples(index=False, name=None))) == sorted(map(repr, want[names].itertuples(index=False, name=None)))


# 11


def clustered(rows, clusters, rounds, dimension):
    """(key, cluster, distance, inertia of it, inertia, digest) by comparing everything in Python integers."""
    kept = [(k, [math.floor(64 * x) for x in v]) for k, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:clusters]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((distance(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        centres = [[sum(x) // len(members[i]) for x in zip(*members[i], strict=True)] if members[i] else c for i, c in enumerate(centres)]
    found = [(k, *near(v)[::-1]) for k, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return [(k, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for k, c, d in found]


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("kind", ["spread", "grouped", "ties", "few"])
def test_clusters_equal_brute_force(spark, kind):
    rng = random.Random(kind)
    heads = [[rng.gauss(0, 2) for _ in range(6)] for _ in range(5)]
    make = {
        "spread": lambda: [rng.gauss(0, 1) for _ in range(6)],
        "grouped": lambda: [x + rng.gauss(0, 0.05) for x in rng.choice(heads)],
        "ties": lambda: [rng.choice([-0.01, 0.0, 0.02]) for _ in range(6)],
        "few": lambda: [rng.choice([-1.0, 1.0])] * 6,
    }[kind]
    rows = [(i, make()) for i in range(3 if kind == "few" else 150)]
    rows += rows[:4] + [(rows[0][0], make()), (None, make()), (None, make())]  # repeated rows, an id of two vectors, null ids
    rows += [(900, None), (901, []), (902, [0.1] * 5), (903, [0.1] * 7), (904, [None] + [0.1] * 5), (905, [math.nan] + [0.1] * 5), (906, [math.inf] + [0.1] * 5), (907, [-math.inf] + [0.1] * 5)]
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<float>, cluster int, key int").repartition(3)
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    assert rows_of(centroids.cluster(df, clusters=8, dimension=6)) == sorted(map(repr, clustered(rows, 8, 3, 6)))


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(empty).count() == 0
    assert centroids.cluster(empty.union(spark.createDataFrame([(1, None)], empty.schema))).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    named = spark.createDataFrame([("a", [0.5] * 64), ("b", [0.25] * 64)], "vec_id string, embedding array<double>")
    assert centroids.cluster(named).select("vec_id", "distance").orderBy("vec_id").collect() == [("a", 0), ("b", 0)]


def test_a_component_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="do not fit in 64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()


@pytest.mark.parametrize("width", [1, 2, 4, 5, 64])
def test_bounds_hold_and_prune(width):
    rng = np.random.default_rng(width)
    heads = rng.integers(-200, 200, (16, 64))
    values = heads[rng.integers(0, 16, 500)] + rng.integers(-9, 9, (500, 64))
    values[:5] = [np.full(64, x) for x in (0, 1, -centroids.WIDEST, centroids.WIDEST, 7)]
    rows, packed = (centroids.compressed(*centroids.segments(x, width), width) for x in (values, heads))
    exact = ((values[:, None, :] - heads[None, :, :]) ** 2).sum(2)
    assert (centroids.lower_bounds(rows, packed) <= exact).all()
    cluster, best, computed = centroids.nearest(values, rows, heads, packed)
    assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert width == 64 or computed < 0.2 * exact.size  # most centroids never receive an exact distance


# 13


def audited(rows, least, top):
    """The audit by definition; `rows` are (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = {c: c + 32 for c in range(65, 91)}
    words = [(lang, source, [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, w) for x, s, w in words if x == lang]
        frequency = Counter(t for _, w in mine for t in set(w))
        kept = [t for t, n in frequency.items() if n >= least]
        counts = {s: Counter() for s, _ in mine}
        for s, w in mine:
            counts[s].update(t for t in w if frequency[t] >= least)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        whole, of = p(sum(counts.values(), Counter())), {s: p(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(sum(f(of[s][t], of[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(of[s][t], whole[t]), t) for t in kept if counts[s][t] and of[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("least,top,pairs,entries", [(10, 10, 1 << 22, 1 << 18), (3, 2, 12, 7), (1, 10, 1, 1)])
def test_audit_equals_brute_force(spark, monkeypatch, least, top, pairs, entries):
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "CELLS", 20)
    rng = random.Random(least)
    words = ["the", "The", "THE", "été", "ÉTÉ", "naïve", "x", "𝔘𝔫", "ﬁ", "a1b", "q_q", "don't", " ", " ", "İ", "zz"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "de", "", None, "fr"]), rng.choice(["s0", "s0", "s0", "s1", "é", "", None, "s𝔘"]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(250)]
    rows += rows[:30] + [("en", "s0", "same same same")] * 40 + [("en", "s1", None), ("it", "s0", None), ("it", "s1", ""), ("pl", "alone", "x y z"), ("en", "long", "the été " * 20_000)]
    df = spark.createDataFrame([(i % 9, lang, source, text, 1, "k") for i, (lang, source, text) in enumerate(rows)], "doc_id int, lang string, source string, text string, rank int, term string").repartition(5)
    assert rows_of(divergence.audit(df, least, top)) == audited(rows, least, top)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_shares_do_not_overflow():
    rng = random.Random(1)
    for _ in range(2_000):
        total = rng.randint(0, 9 * 10**14)
        count, size = rng.randint(0, total), rng.randint(1, 10**9)
        got = int(divergence.shares(np.array([count]), np.array([total]), size)[0])
        assert got == 1 + 10**9 * (count + 2) // (total + 2 * size)
