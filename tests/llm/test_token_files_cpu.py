"""What keeps the CPU time of `op12_token_files` in bounds, and that ids and files stay what they were."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import packing, token_files

BLOCK = token_files.BLOCK


def test_words_of_letters_skip_the_lines(monkeypatch):
    """Words of letters alone go to the library's model; before, its normaliser and pattern read each of them again."""
    encoder = packing.Encoder(packing.vocabulary_path())
    asked, lines = [], encoder._lines
    monkeypatch.setattr(encoder, "_lines", lambda words: asked.extend(words) or lines(words))
    letters = "".join(c for c in map(chr, range(256)) if c.isalpha() and c == c.lower())
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list(letters), n)) for n in rng.integers(1, 40, 3000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + ["Straße ÀÉÎ, ªº µ ÿ ÷ × 'ß's x1 ½é"]
    want = [x.ids for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert asked and not any(map(str.isalpha, asked))


def test_other_vocabularies_keep_the_lines(monkeypatch):
    """The model is asked alone only where it gives the ids of the whole library for every letter."""
    monkeypatch.setattr(packing.Encoder, "_letters", lambda self, word: b"")
    encoder = packing.Encoder(packing.vocabulary_path())
    assert not encoder.direct
    want = encoder.tokenizer.encode("plain wörds", add_special_tokens=False).ids
    assert [x.tolist() for x in encoder.encode(["plain wörds"])] == [want]


def skewed(n):
    rng = np.random.default_rng(31)
    follow = rng.integers(0, 3000, (3000, 5))
    ids = np.zeros(n, np.uint16)
    for i, choice in enumerate(rng.choice(6, n - 1, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1])):
        ids[i + 1] = follow[ids[i], choice] if choice < 5 else i * 7919 % 3000
    return ids


def test_what_a_step_looks_up_is_small():
    """Cells and weights have 16 bits, facts of an entry are one number; before, 32 and 64 bits and three numbers fell out of the caches."""
    image = token_files.Image(token_files.write_image(pa.array([1]), np.array([40 * BLOCK]), skewed(40 * BLOCK)))
    tables = image.tables
    assert len(tables.entry_list) > 1000
    assert tables.cells.itemsize == 2 and token_files._Weights(3).now().itemsize == 2
    assert tables.facts.nbytes == 8 * len(tables.ids)


@pytest.mark.parametrize("at_once", [1, 70, 1 << 16])
def test_files_have_the_same_bytes(monkeypatch, at_once):
    """However many contexts are looked up at once; the digest is that of the file as written before."""
    monkeypatch.setattr(token_files, "AT_ONCE", at_once)
    monkeypatch.setattr(token_files, "MOST", 900)
    ids = skewed(33 * BLOCK + 5)
    ranks = np.unique(ids, return_inverse=True)[1].astype(np.uint16)
    shares = token_files.counts_of(ids)[1]
    tables = token_files.Tables(shares, token_files.lists_of(ranks, shares))
    codes = token_files.encode_blocks(ranks, tables)
    assert hashlib.sha256(b"".join(codes)).hexdigest() == "1ee032a7eb221834f21841410b93e762f0100b7d2b72f599f8b90fbfe724d0be"
    assert np.array_equal(token_files.decode_blocks(codes, [BLOCK] * 33 + [5], tables), ranks)


@pytest.mark.parametrize("byte", [b"\x00", b"\xff", b"\x5a"])
def test_a_lost_block_is_found(byte):
    ids = skewed(5 * BLOCK)
    data = token_files.write_image(pa.array([1]), np.array([len(ids)]), ids)
    ends = token_files.Image(data).ends.tolist()
    broken = token_files.Image(data[: ends[2]] + byte * (ends[3] - ends[2]) + data[ends[3] :])
    assert np.array_equal(broken.blocks(0, 2), ids[: 2 * BLOCK]) and np.array_equal(broken.blocks(3, 5), ids[3 * BLOCK :])
    with pytest.raises(ValueError, match="damaged"):
        broken.blocks(2, 3)
