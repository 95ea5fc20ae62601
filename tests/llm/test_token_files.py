"""Files of token ids: round trips, damage, random access, and the query against the tokenizers library."""

import json
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomspan.llm import packing, token_files

RNG = np.random.default_rng(12)
BLOCK = token_files.BLOCK
SERIES = {
    "none": np.empty(0),
    "one": np.array([7]),
    "same": np.full(3 * BLOCK, 65535),
    "zeros": np.zeros(BLOCK + 1),
    "few": RNG.integers(0, 3, BLOCK),
    "noise": RNG.integers(0, 65536, 2 * BLOCK + 77),
    "all": np.arange(65536),
    "skew": RNG.zipf(1.1, 5 * BLOCK + 1) % 49_000,
    "period": np.tile(np.arange(600), 40),
    "late": np.concatenate((np.zeros(BLOCK - 1), RNG.integers(0, 65536, 3), np.ones(BLOCK))),
}


@pytest.mark.parametrize("name", SERIES)
def test_blocks_come_back(name, monkeypatch):
    ids = SERIES[name].astype(np.uint16)
    for lanes in (3, 2048):
        monkeypatch.setattr(token_files, "LANES", lanes)
        image = token_files.Image(token_files.write_image(pa.array(["x"]), np.array([len(ids)]), ids))
        assert np.array_equal(image.ids(), ids)
    for i in range(0, len(image.sums), 2):  # blocks by themselves
        assert np.array_equal(image.blocks(i, i + 1), ids[i * BLOCK : (i + 1) * BLOCK])


def test_weights_are_halved(monkeypatch):
    monkeypatch.setattr(token_files, "MOST", 700)
    ids = np.concatenate((np.tile(np.arange(9), 700), RNG.integers(0, 200, 6000))).astype(np.uint16)
    assert np.array_equal(token_files.Image(token_files.write_image(pa.array([1]), np.array([len(ids)]), ids)).ids(), ids)


def test_contexts_pay():
    """Order 1 and 2 tell what counts cannot: a random walk whose next id follows from the last two."""
    follow = RNG.integers(0, 12, (12, 12, 4))
    ids, two = [], (0, 1)
    for choice in RNG.choice(4, 60_000, p=[0.9, 0.06, 0.03, 0.01]):
        two = two[1], int(follow[(*two, choice)])
        ids.append(two[1])
    ids = np.array(ids, np.uint16)
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    image = token_files.write_image(pa.array([1]), np.array([len(ids)]), ids)
    assert 8 * len(image) < 0.6 * len(ids) * -(p * np.log2(p)).sum()


def test_damage_is_found():
    ids = (RNG.zipf(1.3, 3 * BLOCK) % 5000).astype(np.uint16)
    data = token_files.write_image(pa.array([1]), np.array([len(ids)]), ids)
    sound = token_files.Image(data)
    for at in range(int(sound.ends[1]), int(sound.ends[2]), 991):
        broken = token_files.Image(data[:at] + bytes([data[at] ^ 0x5A]) + data[at + 1 :])
        assert np.array_equal(broken.blocks(0, 1), ids[:BLOCK]) and np.array_equal(broken.blocks(2, 3), ids[2 * BLOCK :])
        try:
            assert np.array_equal(broken.blocks(1, 2), ids[BLOCK : 2 * BLOCK])  # a last bit may not matter
        except ValueError as e:
            assert "damaged" in str(e)
    with pytest.raises(ValueError, match="not a file"):
        token_files.Image(b"something else, of some length")


def brute(rows, path):
    """(doc_id, start, n_tokens, crc32) by the library itself; rows of one id in any order, so starts are compared by the ids' order."""
    tokenizer = Tokenizer.from_file(path)
    made = [(k, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for k, t in rows]
    return [(k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in made]


def test_query_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 3000)
    path = packing.vocabulary_path()
    texts = ["The quick brown fox", None, "", " ", "ΑΣ Σ ς İ ﬁ   a b \x00 ퟿ 𝔘", "word " * 9000, "x" * 5000, "a\tb\nc  d", "don't (stop) 3.14 #tag", "日本語テキスト"]
    rows = [(i * 3, texts[i % len(texts)]) for i in range(60)] + [(3, "again"), (3, "again"), (3, "other"), (None, "no id"), (None, None), (-5, "minus")]
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, part int, nth int, start int").repartition(6)
    got = sorted(token_files.through_files(df, with_ids=True).collect(), key=lambda r: r.start)
    want = brute(rows, path)
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(repr, want))
    assert [r.start for r in got] == [0, *accumulate(r.n_tokens for r in got)][:-1]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda k: (k is not None, k or 0))
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.ids[-1] == 1 for r in got)


def test_keys_of_text_and_no_rows(spark):
    named = spark.createDataFrame([("b", "two words"), ("a", "one")], "doc_id string, text string")
    got = token_files.through_files(named).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in got] == [("a", 0), ("b", got[0].n_tokens)]
    assert token_files.through_files(named.limit(0)).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op12_token_files(spark, sf).collect()}
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want = brute(rows, packing.vocabulary_path())
    starts = [0, *accumulate(n for _, n, _ in want)]
    assert got == {k: (start, n, crc) for (k, n, crc), start in zip(want, starts, strict=False)}


def test_header_says_what_is_there():
    data = token_files.write_image(pa.array([5, None, 9]), np.array([1, 2, 3]), np.arange(6, dtype=np.uint16))
    size = int.from_bytes(data[8:12], "little")
    assert json.loads(data[12 : 12 + size])["documents"] == 3
    assert token_files.Image(data).keys.to_pylist() == [5, None, 9]
