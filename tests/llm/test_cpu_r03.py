"""What keeps the CPU time of the operators of round 3 in bounds, and that results stay the library's."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame
from tokenizers import Tokenizer

from loomspan.llm import class_lm, divergence, packing, token_files

ODD = "aA bBß'sİΣςé'é\n\t\r\x0b\x1c\x85\xa0 .,!?\"09-#%_ªº²½́ﬁ日\x00​'ll've''''xyzu÷×þ"


def test_words_share_their_pre_tokens(monkeypatch):
    """words with marks are put together from known parts; before, each of them was encoded."""
    encoder = packing.Encoder(packing.vocabulary_path())
    asked, lines = [], encoder._lines
    monkeypatch.setattr(encoder, "_lines", lambda words: asked.extend(words) or lines(words))
    names = ["".join(random.Random(i).choices("abcdefgh", k=9)) for i in range(40)]
    texts = [f"{n} {n}, {n}.\n{m}! ({n})" for n, m in zip(names, names[1:], strict=False)]
    want = [x.ids for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert len(asked) <= len(names) + 6


def test_odd_texts_equal_the_library(monkeypatch):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rng = random.Random(5)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(70))) for _ in range(4000)] + ["", " ", "\n", "x" * 16, "x" * 17, "x" * 16 + "'s", "A" * 40 + ",b", "hi<|endoftext|>you", "<|endoftext|"]
    want = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    monkeypatch.setattr(packing, "AT_ONCE", 500)
    for most in (0, 30, packing.CACHE):  # no room, little, and enough
        encoder = packing.Encoder(packing.vocabulary_path(), most)
        for _ in range(2):
            assert [x.tolist() for x in encoder.encode(texts)] == want


def test_blocks_know_the_contexts_of_their_file():
    """what follows what is told once for a file; before, each block learned it anew."""
    rng = np.random.default_rng(3)
    follow = rng.integers(0, 1000, (1000, 4))
    ids = np.zeros(100 * token_files.BLOCK, np.uint16)
    for i, choice in enumerate(rng.choice(4, len(ids) - 1, p=[0.7, 0.1, 0.1, 0.1])):
        ids[i + 1] = follow[ids[i], choice]
    image = token_files.write_image(pa.array([1]), np.array([len(ids)]), ids)
    assert np.array_equal(token_files.Image(image).ids(), ids)
    assert 8 * len(image) < 4 * len(ids)


def test_runs_are_sorted_by_term_first(spark):
    """where lang came first, every comparison of a language's rows had to look at the rows themselves."""
    docs = spark.createDataFrame([("a b", "en", "x")], "text string, lang string, source string")
    plan = divergence.kept_terms(docs)._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    assert len(sorts) == 2 and all("Sort [term#" in line for line in sorts)


def test_a_round_shuffles_once(spark, monkeypatch):
    """counts were summed by item and context, then shuffled again by item."""
    plans, real = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or real(self))
    lines = [np.array([0, 1, 0, 1, 2, 3], "<i4"), np.array([2, 1, 2, 0, 3], "<i4")]
    encoded = spark.createDataFrame([(False, bytearray(x.tobytes())) for x in lines], "held_out boolean, ids binary")
    of = np.array([0, 1, 0, 2])
    table = class_lm.count_pairs(encoded, of)
    got = class_lm.exchange_round(encoded, of, table, np.array([True, True, True, False]))
    assert len(got) == 4 and got[3] == 2 and plans[0].count("Exchange ") == 1
