"""The training-data operators against brute force, with nulls, empty and long texts, repeats, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.llm import class_lm, components, decontaminate, gif, html_extract, jaccard_join, packing, quality, registry, sharding, token_counts, url_filter
from loomspan.llm.text import shingle_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, sid string"


def odd_docs(spark, texts=()):
    """Nulls, empty, blank, long and repeated texts; columns whose names the operators use themselves."""
    base = [None, "", "  \n\t ", "word", "Ünï çödé " * 30, "abc def " * 40_000, "same text of six words here", "same text of six words here"]
    rows = [(i, t, "en", "s", None, "x", "y") for i, t in enumerate([*base, *texts])]
    return spark.createDataFrame([*rows, rows[6], (None, "null id text", None, None, None, None, None)], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    plain = lambda df: sorted(repr(tuple(None if v is None or v != v else v for v in r)) for r in df[names].itertuples(index=False, name=None))
    assert plain(got) == plain(want)


# 1


def test_windows_by_brute_force(spark):
    random.seed(1)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([1, 3, 9, 10, 12, 25])))) for i in range(8)] + [(90, None), (91, "..."), (None, "w1 w2")]
    texts = [" ".join(random.choices(vocabulary, k=60)) + " " + random.choice(items[:8])[1] for _ in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = odd_docs(spark, texts)
    for block in (1 << 20, 1):
        got = {r.doc_id: r for r in decontaminate.digest(decontaminate.find_windows(docs, benchmark, block_bytes=block)).collect()}
        for r in docs.collect():
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").lower())
            hit, ids = set(), set()
            for i, t in items:
                w = re.findall(r"[a-z0-9]+", t or "")
                m = min(10, len(w))
                for p in range(len(w) - m + 1) if w and i is not None else ():
                    for q in range(len(words) - m + 1):
                        if words[q : q + m] == w[p : p + m]:
                            hit |= set(range(q, q + m))
                            ids.add(i)
            x = got[r.doc_id]
            assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (len(words), len(hit), len(ids), bool(hit))
            assert x.items_sha256 == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    named = spark.createDataFrame([(f"i{i}", t) for i, t in items[:8]] * 2, "item_id string, text string")
    again = docs.unionByName(docs)
    twice = Counter((r.doc_id, len(r.spans), tuple(r.items)) for r in decontaminate.find_windows(again, named, block_bytes=1).collect())
    assert twice == Counter({(d, s, tuple(sorted(f"i{i}" for i in its))): n for (d, s, its), n in Counter((r.doc_id, len(r.spans), tuple(r.items)) for r in decontaminate.find_windows(again, benchmark.where("item_id < 90")).collect()).items()})
    assert decontaminate.find_windows(empty_docs(spark), benchmark).count() == 0
    assert decontaminate.digest(decontaminate.find_windows(docs, benchmark.limit(0))).where("contaminated").count() == 0


# 2


def test_main_text():
    page = """<html><head><title>T</title><script>var a="</p><p>no";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><div class="ad">Buy this now, it is cheap<article><h1>Head &amp; more</h1><p>One&nbsp;two<br>three <b>bold<p>Second
    paragraph, long enough to be counted as text of the page.<ul><li>item</ul></article><aside>See also</aside><section id="comments"><article>first!</article></section><footer>&copy; X</footer>"""
    assert html_extract.main_text(page) == "Head & more\nOne two three bold\nSecond paragraph, long enough to be counted as text of the page.\nitem"
    plain = "<div id=menu><a href=x>a</a> <a href=y>b</a></div><div><p>" + "Some long body text here. " * 10 + "</p><p>Short end.</p></div><div class=footer>foot</div>"
    assert html_extract.main_text(plain).split("\n")[1] == "Short end."
    for odd in (None, "", "<", "<![foo", "<p>", "a<b", "<!-- x", "<script>"):
        assert isinstance(html_extract.main_text(odd), str)
    assert html_extract.main_text("just text") == "just text"


def test_article_keeps_its_short_lines():
    long, short = [f"<p>{'long text %d ' % i * 50}</p>" for i in range(6)], [f"<p>Closing line {i} of some forty characters.</p>" for i in range(3)]
    nav = "<body><nav><a href=/>Home</a><a href=/b>More</a></nav>"
    for box in ("div class=body", "blockquote", "section", "table"):
        inner = f"<h1>Short title</h1><{box}>{''.join(long)}</{box.split()[0]}>{''.join(short)}"
        for page in (f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article><p>About us</p></main>"):
            got = html_extract.main_text(f"{nav}{page}<footer>foot</footer>").split("\n")
            assert got[0] == "Short title" and len(got) == 10 and got[-1] == "Closing line 2 of some forty characters."
    apart = html_extract.main_text(f"{nav}<div><section>{''.join(long)}</section><p>Between.</p><section>{long[0]}</section></div>")
    assert "Between." in apart.split("\n")


BOILERPLATE = (
    "<nav><ul><li><a href=/>Home</a><li><a href=/x>More &amp; more</a></ul></nav>", "<aside><p>{0}</aside>", "<div class='ad banner'>{0}</div>", "<script>var a='<p>{0}</p>'</script>", "<style>p{{}}</style>",
    "<form><label>Mail</label><input value='{0}'><button>Go</button></form>", "<div id=cookie-notice>{0}</div>", "<div class=sidebar><p>{0}</p><p>{0}</p></div>", "<section id=comments><p>{0}</p><article>{0}</article></section>",
    "<footer>&copy; {0}</footer>", "<div role=navigation>{0}</div>", "<!-- {0} -->", "<p hidden>{0}</p>", "<div class='related share'><a href=/>{0}</a></div>",
)


def made_page(rng, box):
    """A page of known blocks: (html, its main text)."""
    blocks, want, words = [], [], [f"w{i}" for i in range(50)] + ["&eacute;t&eacute;", "a&nbsp;b", "&lt;tag&gt;", "x<br>y", "<b>bold</b>", "<i>it</i>alic", "&#x4e2d;", "<a href=/l>link</a>"]
    plain = {"&eacute;t&eacute;": "été", "a&nbsp;b": "a b", "&lt;tag&gt;": "<tag>", "x<br>y": "x y", "<b>bold</b>": "bold", "<i>it</i>alic": "italic", "&#x4e2d;": "中", "<a href=/l>link</a>": "link"}
    junk = lambda: rng.choice(BOILERPLATE).format(" ".join(rng.choices(words[:50], k=rng.choice([3, 40]))))
    for i in range(rng.randint(3, 12)):
        got = rng.choices(words, k=rng.choice([2, 6, 40, 120]) if 0 < i < 3 else rng.choice([30, 90]))
        blocks.append(f"<{(t := rng.choice(['p', 'h2', 'blockquote', 'pre']))}>{rng.choice([' ', chr(10), '  '])}{' '.join(got)}</{t}>")
        want.append(" ".join(plain.get(w, w) for w in got))
        if rng.random() < 0.3:
            blocks.append(junk())
    html = f"<html><head><title>T</title></head><body>{junk()}{junk()}<{box}>{''.join(blocks)}</{box.split()[0]}>{junk()}{junk()}</body></html>"
    return html, "\n".join(want)


def test_main_text_of_made_pages(spark):
    rng = random.Random(11)
    pages = [made_page(rng, box) for box in ("article", "main", "div class=body") for _ in range(60)]
    rows = [(i, f"http://x/{i}", html, "clash", 1, "clash") for i, (html, _) in enumerate(pages)]
    huge = "<article>" + "<p>one more paragraph of a very long page</p>" * 60_000 + "</article><footer>x</footer>"
    rows += [rows[0], rows[0], (None, None, huge, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, n_lines string")
    got = html_extract.extract_pages(df).collect()
    assert Counter((r.page_id, r.text) for r in got if r.page_id is not None) == Counter([(i, w) for i, (_, w) in enumerate(pages)] + [(0, pages[0][1])] * 2)
    assert all(r.n_chars == len(r.text) for r in got)
    assert [r.text.count("\n") for r in got if r.page_id is None] == [59_999]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_ratios_decide(monkeypatch):
    """With the weights of the tags as they are, other ratios of characters to tags make other texts, and no weight is 0."""
    rng = random.Random(12)
    pages = [made_page(rng, box) for box in ("article", "div") for _ in range(40)]
    numbers, given = np.random.default_rng(1), html_extract.ratios_of
    for other in (lambda r: numbers.random(len(r)), lambda r: 1 / r):

        def changed(lines, forms=False, other=other):
            plain = np.array([min(x.chars / max(1, x.tags), html_extract.MOST) for x in lines])
            weights = given(lines, forms) / plain
            assert (weights >= html_extract.SOFT - 1e-12).all() and (weights <= 1).all()
            return weights * other(plain)

        monkeypatch.setattr(html_extract, "ratios_of", changed)
        assert sum(html_extract.main_text(html) != want for html, want in pages) > 70


def test_smoothing_lifts_short_lines(monkeypatch):
    long = "<p>" + "some long body text here. " * 20 + "</p>"
    page = f"<body><div>{long}{long}<p><i><b></b></i><span></span>Yes</p>{long}<p><i></i><i></i>12 {long}</div>"
    assert html_extract.main_text(page).split("\n")[2] == "Yes"
    monkeypatch.setattr(html_extract, "smooth", lambda ratios, places: ratios)
    assert "Yes" not in html_extract.main_text(page).split("\n")


LONG = "Some long text of the page, with commas, words and a stop at its end. " * 4


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form action=/x><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></form></body>",
        f"<body><article><h1>Head</h1><p>{LONG}</p><section id=related-work><p>{LONG}</p></section></article></body>",
        f"<body><article><h1>Head</h1><div class=share-price-table><p>{LONG}</p></div><p>{LONG}</p></article></body>",
        f"<body><div><div class=article-header><h1>Head</h1></div><p>{LONG}</p><p>{LONG}</p></div></body>",
        f"<body><nav><a href=/>Home</a></nav><form><label>Mail</label><input></form><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></article></body>",
    ],
)
def test_text_in_odd_places_stays(page):
    assert html_extract.main_text(page).split("\n") == ["Head", LONG.strip(), LONG.strip()]


@pytest.mark.parametrize("junk", ["<button>Go</button>", "<textarea>Go</textarea>", "<noscript>Go</noscript>", "<iframe>Go</iframe>", "<template>Go</template>", "<svg><text>Go</text></svg>", "<span class=ad>Go</span>", "<span hidden>Go</span>", "<a class=share href=/>Go</a>", "<span style='display: none'>Go</span>", "<select><option>Go</select>", "<script>Go</script>"])
def test_what_is_no_text_inside_a_line(junk):
    for box in ("article", "div"):
        assert html_extract.main_text(f"<body><{box}><p>{LONG}{junk} end</p><p>{LONG}</p></{box}></body>").split("\n") == [f"{LONG}end", LONG.strip()]


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, "<p>x y"), (2, "u", "")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in html_extract.extract_pages(df).collect()) == [("", 0), ("", 0), ("x y", 3)]


# 3


def test_language_model(spark):
    docs = odd_docs(spark, [f"alpha beta gamma{i % 7} Delta" for i in range(40)])
    got = class_lm.score_texts(docs, top=5, words=3, shapes=3, classes=4).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: (r.text or "") for r in docs.collect()}
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None]
    counts = Counter(x for r in docs.collect() if not class_lm.held_out(r.doc_id) for x in tokens(r.text or ""))
    n, v = sum(counts.values()), len(counts)
    for r in got:
        w = tokens(texts[r.doc_id])
        base = sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 10 == 0)
    assert class_lm.score_texts(empty_docs(spark)).count() == 0


def test_model_beats_base_on_held_out_texts(spark):
    got = registry.QUERIES["op3_class_lm"](spark, SF).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_words_of_one_ending_have_classes_of_their_own(spark):
    train = [i for i in range(200) if not class_lm.held_out(i)]
    out = [i for i in range(200) if class_lm.held_out(i)][:2]
    rows = [(d, f"p a0zz q b0zz p a{1 + d % 9}zz q b{1 + d % 9}zz") for d in train] + [(out[0], "p a3zz q b3zz"), (out[1], "p b3zz q a3zz")]
    got = {r.doc_id: r.score for r in class_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), words=4, shapes=3, classes=7).collect()}
    assert got[out[0]] > got[out[1]] + 2


@pytest.mark.parametrize(("sweeps", "top"), [(0, 40), (3, 40), (3, 12)])
def test_score_by_brute_force(spark, sweeps, top):
    """Scores from their definition: classes of the model, of items and of other words, everything else counted anew from the texts."""
    rng = random.Random(8)
    vocabulary = [f"{rng.choice(['run', 'walk', 'Tree', 'é', '12'])}{i}{rng.choice(['ing', 's', '!', ''])}" for i in range(120)]
    docs = odd_docs(spark, [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(120)], k=rng.choice([0, 3, 30, 200]))) for _ in range(80)])
    model, rare, texts = class_lm.learn(docs, top=top, words=10, shapes=5, classes=6, sweeps=sweeps, least=2)
    got = Counter((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in class_lm.score_with(model, texts).collect())
    assert len(model.items.words) <= top and len(model.likelihoods) <= sweeps + 2 and model.likelihoods == sorted(model.likelihoods)
    told = {bytes(r.word): r["class"] for r in rare.collect() if r["class"] is not None}
    assert bool(told) == bool(sweeps) and not told.keys() & model.items.words.keys()
    rows = [(r.doc_id, class_lm.words_of((r.text or "").encode()) + [class_lm.END]) for r in docs.collect()]
    item = lambda w: model.items.end if w == class_lm.END else model.items.of(w)
    group = lambda w: told.get(w, int(model.of[item(w)]))
    train = [w for d, w in rows if not class_lm.held_out(d)]
    seen = Counter(x for w in train for x in w)
    pairs = Counter((a, b) for w in train for a, b in zip([group(class_lm.END), *map(group, w)], map(group, w), strict=False))
    k, total, n = len(model.steps), Counter(), sum(seen.values())
    kinds, once, twice = Counter(), Counter(), Counter()
    for x, c in seen.items():
        total[group(x)] += c
        kinds[group(x)] += 1
        once[group(x)] += c == 1
        twice[group(x)] += c == 2
    into, whole = Counter(), sum(pairs.values())
    for (_, b), c in pairs.items():
        into[b] += c

    def step(a, b):
        follow = max(1, sum((a, x) in pairs for x in range(k)))
        share = (into[b] + 0.5) / (whole + 0.5 * k)
        return np.log10((pairs[(a, b)] + follow * share) / (sum(pairs[(a, x)] for x in range(k)) + follow))

    def emit(x):
        g = group(x)
        d = min(0.9, max(0.1, once[g] / max(1, once[g] + 2 * twice[g])))
        spare = max(d * max(kinds[g], 1), 0.5)
        return np.log10((seen[x] - d if seen[x] else spare) / (total[g] - d * kinds[g] + spare))

    want = Counter()
    for d, w in rows:
        score = sum(step(a, b) for a, b in zip([group(class_lm.END), *map(group, w)], map(group, w), strict=False)) + sum(map(emit, w))
        base = sum(np.log10((seen[x] + 0.1) / (n + 0.1 * (len(seen) + 1))) for x in w)
        want[(d, sum(seen[x] > 0 for x in w), round(float(base), 6), round(float(score), 6))] += 1
    assert got == want


def test_every_frequent_word_is_exchanged(spark):
    """Rounds over the whole vocabulary make training texts likelier, and held-out texts of known words too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    score = {}
    for sweeps in (0, 4):
        model, _, texts = class_lm.learn(docs, sweeps=sweeps)
        known = class_lm.score_with(model, texts).where("held_out AND n_known = n_tokens").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        score[sweeps] = known[0] / known[2]
        assert score[sweeps] > known[1] / known[2]
    assert (model.counts[:-1] >= class_lm.LEAST).sum() > 10_000 and len(model.likelihoods) > 2 and score[4] > score[0] + 0.05


def test_words_beyond_the_items_have_classes_of_their_own(spark):
    """Of one ending, and none of them an item: what comes before and after them tells them apart."""
    train = [i for i in range(400) if not class_lm.held_out(i)]
    out = [i for i in range(400) if class_lm.held_out(i)][:2]
    rows = [(d, f"p q p q p a{d % 40}zz q b{d % 40}zz p") for d in train] + [(out[0], "p a3zz q b3zz p"), (out[1], "p b3zz q a3zz p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, rare, texts = class_lm.learn(docs, top=2, words=2, shapes=3, classes=5)
    told = {bytes(r.word): (r.n, r["class"]) for r in rare.collect()}
    assert set(model.items.words) == {b"p", b"q"} and len(told) == 80
    assert {c is not None for n, c in told.values() if n >= class_lm.LEAST} == {True}
    assert class_lm.score_with(model, texts).count() == len(rows)


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    big = np.zeros((9, 9))
    for a in range(8):
        for b in range(8):
            if a % 2 != b % 2:
                big[a, b] = rng.integers(50, 60)
    big[8, 0] = big[1, 8] = 1
    of = class_lm.exchange(big, 3)
    assert len({*of[0:8:2]}) == 1 and len({*of[1:8:2]}) == 1 and of[0] != of[1]


# 4


def test_store(spark):
    docs = odd_docs(spark, [f"text {i}" for i in range(50)])
    store = sharding.shard_documents(docs, scratch.fresh_path(spark, "test-store"), target=200_000)
    key = lambda r: repr(tuple(r[: len(docs.columns)]))
    assert sorted(map(key, store.table(docs.schema).select(docs.columns).collect())) == sorted(map(key, docs.collect()))
    base, shards = store.read()
    store.commit(base, shards)
    with pytest.raises(Exception, match="exist"):
        store.commit(base, shards)
    assert store.read(base)[1] == shards
    empty = sharding.shard_documents(empty_docs(spark), scratch.fresh_path(spark, "test-store"))
    assert empty.read() == (0, []) and empty.table(docs.schema).count() == 0


def test_versions_survive_compaction_and_vacuum(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 512)).alias("text")).repartition(6)
    store = sharding.Store(spark, scratch.fresh_path(spark, "test-store"))
    states = {}
    for k in range(5):
        states[store.append(docs.where(f"doc_id % 5 = {k}"))] = {i for i in range(6000) if i % 5 <= k}
        version = store.compact(docs.schema, target=90_000)
        states[version] = {i for i in range(6000) if i % 5 <= k}
    assert len(states) > 6
    for v, ids in states.items():  # also those whose files were merged since
        assert sorted(r.doc_id for r in store.table(docs.schema, v).select("doc_id").collect()) == sorted(ids)
    shards = store.read()[1]
    assert not sharding.plan_merges(shards, 90_000, sharding.FAN_IN) and all(s.bytes <= 1.6 * 90_000 for s in shards)
    tiers = Counter(s.tier() for s in shards if 2 * s.bytes < 90_000)
    assert all(n < sharding.FAN_IN for n in tiers.values())
    assert sum(s.rows for s in shards) == 6000 and {(r[0].rows, r[0].bytes, r[0].tier) for r in store.table(docs.schema).select('__shard').collect()} == {(s.rows, s.bytes, s.tier()) for s in shards}
    docs.limit(10).write.parquet(f"{store.root}/data/orphan")  # a writer that died before its commit
    assert store.vacuum(retain=2) == []
    gone = store.vacuum(retain=2, age_seconds=-60)
    assert any("orphan" in p for p in gone) and len(store.versions()) == 2
    for v in store.versions():
        assert store.table(docs.schema, v).count() == len(states[v])
    with pytest.raises(Exception, match="(?i)not.exist|not found"):
        store.read(1)


def test_large_arrivals_are_split(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1)
    store = sharding.Store(spark, scratch.fresh_path(spark, "test-store"))
    store.append(docs)
    assert len(store.read()[1]) == 1
    store.compact(docs.schema, target=50_000)
    shards = store.read()[1]
    assert len(shards) >= 4 and max(s.bytes for s in shards) <= 75_000 and store.table(docs.schema).count() == 4000


def test_merge_plan():
    shards = [sharding.Shard(f"p{i}", 1, 1000) for i in range(9)] + [sharding.Shard("big", 1, 90_000)]
    groups = sharding.plan_merges(shards, 100_000, 4)
    assert [len(g) for g in groups] == [9] and not sharding.plan_merges(shards[:3], 100_000, 4)


def test_shards_of_clashing_names(spark, tmp_path):
    """Columns named as the facts, their fields or the reader's own are the documents' own."""
    docs = spark.createDataFrame([(i, f"t{i}", i + 1, "p", 0.5, "v", i) for i in range(40)], "doc_id long, text string, shard long, path string, tier double, version string, `rows` long")
    store = sharding.shard_documents(docs, f"file://{tmp_path}/s")
    got = store.table(docs.schema)
    assert got.columns == [*docs.columns, "__shard"] and sorted(map(tuple, got.drop("__shard").collect())) == sorted(map(tuple, docs.collect()))
    with pytest.raises(ValueError, match="name another"):
        store.table(docs.schema, facts="tier")


# 5


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/x?q#f", "x://example.org/en/1", "http://my.casino.net/", "http://casinos1.net/x", "http://free-bets.net", "http://free.net/free", "http://example.com/fr/casino", "a://b?c://d"]
    urls += ["http://x.org/a-" + "b" * 200_000 + "/casino", "http://free-bets.net", "http://spam-farm.net/", "http://adult-x.net", "http://cheap-pills.net", "http://free-free.net/free", "http://farm-free.net/"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block")
    assert [got[i][3] for i in (5, 6, 7, 8, 9)] == ["block", "allow", "block", "allow", "allow"]
    assert [got[i][3] for i in range(11, 18)] == ["allow", *["block"] * 4, "allow", "allow"]  # org/ is allowed whatever its path; one soft term counts once
    assert max(url_filter.SOFT.values()) < url_filter.SOFT_LIMIT and len(set(url_filter.SOFT.values())) > 1 and not url_filter.SOFT.keys() & set(url_filter.STRICT)
    assert Counter(r.page_id for r in url_filter.judge_urls(df.unionByName(df)).collect()) == Counter({i: 2 for i in range(len(urls))})
    assert url_filter.judge_urls(df.limit(0)).count() == 0


# 6


def test_edits_equal_full_counts():
    random.seed(2)
    counter = token_counts.counter_for(None)
    texts = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:40] + ["", "a", "   " * 50, "x" * 3000]
    for text in texts:
        for leaf in (1, 3, 64):
            tree = token_counts.TokenTree(text, counter, leaf)
            assert tree.tokens == counter.whole(text)
            for _ in range(5):
                a = random.randint(0, len(tree.text))
                tree.edit(a, min(len(tree.text), a + random.choice([0, 1, 5, 300])), random.choice(["", " x", "  \n", "'s", "é 12 ", "foo bar " * 30]))
                assert tree.tokens == counter.whole(tree.text) and int(tree.levels[0][0].sum()) == len(tree.text)


def test_stored_trees_and_batches_of_edits(spark):
    """Two batches of random edits on stored trees: counts are those of the edited texts; what has no edits is not counted again."""
    rng, counter = random.Random(9), token_counts.counter_for(None)
    docs = odd_docs(spark, [" ".join(rng.choices(["alpha", "12", "it's", "\n", "é"], k=rng.choice([0, 5, 300, 3000]))) for _ in range(20)])
    trees = scratch.materialize(token_counts.build_trees(docs, leaf=8), "trees")
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert texts == Counter((r.doc_id, r.text) for r in trees.collect()) and all(r.n_tokens == counter.whole(r.text) for r in trees.collect())
    for _ in range(2):
        edits = [(d, s, rng.randint(0, 2000), rng.randint(0, 2000), rng.choice(["", " new words", None, "x"])) for d in range(0, 28, 2) for s in range(rng.randint(1, 4))]
        table = spark.createDataFrame([*edits, edits[0], (None, 0, 0, 1, "z"), (777, 0, 0, 1, "z")], "doc_id long, seq int, start long, end long, new string")
        after = Counter()
        for (d, text), n in texts.items():
            for _, _, a, b, new in sorted((e for e in edits if e[0] == d), key=lambda e: e[1]):
                a, b = min(a, len(text)), min(b, len(text))
                text = text[:a] + (new or "") + text[max(a, b) :]
            after[(d, text)] += n
        trees = scratch.materialize(token_counts.edit_trees(trees, table, leaf=8), "trees")
        rows = trees.collect()
        assert Counter((r.doc_id, r.text) for r in rows) == after and all(r.n_tokens == counter.whole(r.text) for r in rows)
        assert all((r.recounted_leaves > 0) == (r.doc_id in {e[0] for e in edits}) for r in rows)
        assert all(sum(r.leaf_chars) == len(r.text) and sum(r.leaf_tokens) == r.n_tokens for r in rows)
        texts = after


def test_sample_edits_of_odd_rows(spark):
    counter = token_counts.counter_for(None)
    want = Counter()
    for r in odd_docs(spark).collect():
        text = r.text or ""
        n = len(text)
        new = text[: n // 3] + " [masked] " + text[min(n, n // 3 + 12) :]
        new = new[: 2 * n // 3] + " (see note)\n" + new[2 * n // 3 :]
        new = new[: max(0, len(new) - 5)]
        want[(r.doc_id, counter.whole(text), counter.whole(new), len(new))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.edited_tokens, r.edited_chars) for r in token_counts.count_with_edits(odd_docs(spark)).collect()) == want


def test_a_table_of_edits_joins_by_keys(spark):
    """Edits of some texts, of other texts of an id, of no text, repeated ones and null ids."""
    counter = token_counts.counter_for(None)
    rows = [(1, "alpha beta " * 40), (1, "alpha beta " * 40), (1, "other text"), (2, None), (2, ""), (None, "no id at all"), (3, "kept as it is")]
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, id string, none int").repartition(3)
    leaves = scratch.materialize(token_counts.leaf_table(docs, leaf=8), "leaves")
    based = docs.select("doc_id", "text", token_counts.base_of(F.col("text")).alias("base")).distinct()
    edits = based.where("text LIKE 'alpha%' OR text IS NULL OR doc_id IS NULL").select("doc_id", "base", F.lit(1).alias("seq"), F.lit(2).alias("start"), F.lit(5).alias("end"), F.lit("new").alias("new"))
    edits = edits.unionByName(edits).unionByName(spark.createDataFrame([(1, 12345, 1, 0, 9, "z"), (9, 1, 1, 0, 9, "z")], edits.schema))
    got = token_counts.edit_documents(docs, leaves, edits, leaf=8).collect()
    cut = lambda t: t[:2] + "new" + t[5:]
    want = Counter((k, cut(t or "") if (t or "").startswith("alpha") or k is None or not t else t) for k, t in rows)
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_tokens == counter.whole(r.text) and sum(r.leaf_chars) == len(r.text) for r in got)
    assert {r.doc_id for r in got if not r.recounted_leaves} == {1, 3}
    assert token_counts.edit_documents(docs, leaves, edits.limit(0), leaf=8).where("recounted_leaves > 0").count() == 0


def test_edit_is_local(spark):
    tree = token_counts.TokenTree("some words in a row " * 5000, token_counts.counter_for(None))
    leaves, chars = tree.edit(50_000, 50_010, "other")
    assert leaves < 6 and chars < 3000
    got = token_counts.count_with_edits(odd_docs(spark)).collect()
    assert len(got) == odd_docs(spark).count() and token_counts.count_with_edits(empty_docs(spark)).count() == 0


# 7


def test_quality_of_text_ids(spark):
    rows = [(f"id{i}", f"good clean prose number {i} with some plain words" if i % 2 else "buy buy http://x 1234 !!!! $$$", "en", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    labels = spark.createDataFrame([(f"id{i}", i % 2, 0) for i in range(40)], "doc_id string, quality int, toxic int")
    got = {r.doc_id: r.accepted for r in quality.classify(docs, labels).collect()}
    assert len(got) == 60 and sum(got[f"id{i}"] == bool(i % 2) for i in range(60)) > 50


def test_quality(spark):
    texts = [f"good clean prose number {i} with many plain words in it" for i in range(40)] + [f"you idiot scum number {i} with many plain words in it" for i in range(40)]
    docs = odd_docs(spark, texts)
    labels = spark.createDataFrame([(8 + i, 1, int(i >= 40)) for i in range(0, 80, 2)] + [(None, 1, 1), (9999, 0, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(got[8 + i].accepted == (i < 40) for i in range(80))
    assert quality.classify(docs, labels).count() == docs.count()
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns and 8 in {r.doc_id for r in kept.collect()}
    assert quality.classify(empty_docs(spark), labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == docs.count()


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.9)] * 50 + [("bad", "p", 0.1)] * 50 + [("one", "p", 0.1)]
    sites = {r.host: r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    assert sites["bad"].host_posterior < 0.15 < sites["one"].host_posterior < sites["one"].prior


def test_sites_by_brute_force(spark):
    """Posteriors, leave-one-out scores and decisions against plain arithmetic; site and label flip decisions."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        host, path = rng.choice([("good", "a"), ("good", "b"), ("bad", "a"), ("bad", "a"), ("odd", rng.choice("abc"))])
        level = {"good": 0.8, "bad": 0.2, "odd": 0.5}[host] + (0.15 if path == "b" else 0)
        rows.append((i if i % 17 else None, host, path, min(0.999, max(0.001, rng.gauss(level, 0.15)))))
        if i % 6 == 0:
            labels.append((i, int(rng.random() < level), int(rng.random() < 0.1)))
    rows += [(1000, "good", "a", 0.45), (1001, "bad", "a", 0.55), (1002, "lone", "z", 0.6), rows[5], rows[5]]
    labels += [(6, 0, 0), (None, 1, 0), (12, None, 1), (99999, 1, 1)]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")
    told = quality.with_labels(scored, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = Counter((r.doc_id, r.host, r.path, round(r.evidence, 9), round(r.score, 6), r.accepted) for r in quality.combine(told, quality.site_posteriors(told)).collect())
    truth = {}
    for d, q, t in labels:
        if None not in (d, q, t):
            old = truth.get(d, (0, 0))
            truth[d] = (max(old[0], q), max(old[1], t))
    own = [float(truth[d][0] > 0 and truth[d][1] <= 0) if d in truth else e for d, _, _, e in rows]
    by = {}
    for (d, h, p, e), o in zip(rows, own, strict=True):
        by.setdefault(h, {}).setdefault(p, []).append(o)
    flat = [(h, p, v) for h, x in by.items() for p, v in x.items()]
    hosts = {h: [o for v in x.values() for o in v] for h, x in by.items()}
    n, total, squares, k, pk = len(own), sum(own), sum(o * o for o in own), len(hosts), len(flat)
    b, n2, pb = sum(sum(v) ** 2 / len(v) for v in hosts.values()), sum(len(v) ** 2 for v in hosts.values()), sum(sum(v) ** 2 / len(v) for _, _, v in flat)
    spread = (b - total**2 / n - (k - 1) * (squares - b) / max(n - k, 1)) / max(n - n2 / n, 1)
    deeper = (pb - b - (pk - k) * (squares - pb) / max(n - pk, 1)) / max(n * (1 - k / pk), 1)
    prior = total / n
    k1, k2 = (min(1e6, max(1.0, prior * (1 - prior) / max(v, 1e-9) - 1)) for v in (spread, deeper))
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    want, decisions = Counter(), {}
    for (d, h, p, e), o in zip(rows, own, strict=True):
        host = (sum(hosts[h]) - o + k1 * prior) / (len(hosts[h]) - 1 + k1)
        path = (sum(by[h][p]) - o + k2 * host) / (len(by[h][p]) - 1 + k2)
        score = 1 / (1 + np.exp(-(logit(e) + logit(path) - logit(prior))))
        want[(d, h, p, round(e, 9), round(float(score), 6), bool(score >= 0.5))] += 1
        decisions[d] = bool(score >= 0.5)
    assert got == want
    assert decisions[1000] and not decisions[1001]  # the sites flip both: the evidence alone says 0.45 and 0.55


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    row = quality.accuracy(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).first()
    assert row.n > 50 and row.right / row.n > max(0.9, row.base)


def test_training_takes_one_row_of_each_id(spark):
    texts = [(i, f"{'good' if i % 2 else 'bad'} words {i} here") for i in range(60)]
    docs, again = (spark.createDataFrame(rows, "doc_id long, text string") for rows in (texts, texts + [texts[3]] * 50))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    one, two = quality.train(docs, labels), quality.train(again, labels)
    assert one[0].words == two[0].words and (one[0].bins == two[0].bins).all() and b"good" in one[0].words


# 8


def brute(docs):
    sets = [(r.doc_id, set(map(tuple, [w[i : i + 5] for i in range(max(1, len(w) - 4))])) if (w := re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").split()) else set()) for r in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((repr(d), len(s), repr(least.get(root(i)))) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("block, large", [(jaccard_join.BLOCK, jaccard_join.LARGE), (20_000, 2)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, block, large):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    random.seed(4)
    words = [f"v{i}" for i in range(400)]
    texts = []
    for size in (3, 5, 7, 12, 20, 40, 80, 150, 300, 700):
        base = random.choices(words, k=size)
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 12, 20):
            w = list(base)
            for _ in range(edits):
                w[random.randrange(len(w))] = random.choice(words)
            texts.append(" ".join(w[: random.choice([len(w), len(w), int(len(w) * 0.8) + 1])]))
    docs = odd_docs(spark, texts)
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == brute(docs.collect())


def test_heads_that_link_in_the_second_pass(spark, monkeypatch):
    """a and b link, but neither to its head; the heads' components are joined only by p, which the second pass compares with the other head."""
    one, two = [f"w{i}" for i in range(200)], [f"x{i}" for i in range(200)]
    texts = {"k": one[:74], "j": one[10:84], "p": one[20:94], "k2": one[30:104], "a": two[:74], "b": two[10:84]}
    docs = odd_docs(spark, [" ".join(w) for w in texts.values()])
    sid = {x: jaccard_join.set_ids(shingle_hashes(" ".join(w).encode(), 5))[0] for x, w in texts.items()}
    heads = spark.createDataFrame([(sid[x], sid[y]) for x, y in (("j", "k"), ("p", "j"), ("k2", "k"), ("a", "k2"), ("b", "k"))], "sid long, head long")
    monkeypatch.setattr(jaccard_join, "best_heads", lambda buckets, sized: heads)
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == brute(docs.collect())


def test_no_near_duplicates_in_an_empty_table(spark):
    assert jaccard_join.near_duplicates(empty_docs(spark)).count() == 0


def test_linked_sets_share_signatures():
    """Partners at the very limit share the surplus, however the frequent shingles lie; plain sets do so by subsets alone."""
    rng = np.random.default_rng(5)
    by_subsets = 0
    for size in [*range(1, 60), 63, 64, 95, 96, 127, 128, 191, 192, 200, 255, 256, 400, 900, 3000]:
        for _ in range(8):
            common = int(np.ceil(6 * size / 7))
            pool = np.unique(rng.integers(0, 2**63, 3 * size + 8, dtype=np.uint64) * np.uint64(2))
            rng.shuffle(pool)
            a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[:common], pool[size : 2 * size - common]]))
            for x, y in ((a, b), (a, np.sort(pool[: -(-3 * size // 4)]))):
                both = len(np.intersect1d(x, y))
                if jaccard_join.linked(len(x), len(y), both):
                    band = max(len(x), len(y)).bit_length() - 1
                    need = min(jaccard_join.surplus(min(len(x), len(y)).bit_length() - 1), len(x))
                    for part in (0, 3, size // 3, size * 4 // 5, size):
                        often = np.sort(rng.permutation(pool[: 2 * size])[: 2 * part])
                        shared = np.intersect1d(jaccard_join.signatures(x, often), jaccard_join.signatures(y, often))
                        assert len(shared) >= need, (size, part)
                    if band >= jaccard_join.SUBSETS:
                        (s, one), (t, two) = jaccard_join.subsets(x, len(x), band), jaccard_join.subsets(y, len(y), band)
                        if one or two:
                            by_subsets += 1
                            assert len(np.intersect1d(s, t)) >= jaccard_join.surplus(band)
                    assert jaccard_join.at_most(jaccard_join.sketch(x), jaccard_join.sketch(y)) >= both
    assert by_subsets > 400


def test_signatures_are_subsets_of_two_of_three_partitions():
    """Each signature is the contents of exactly two second-level partitions of one partition: what lies elsewhere does not matter."""
    rng = np.random.default_rng(6)
    h = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
    n = jaccard_join.partitions(7)
    made, strong = jaccard_join.subsets(h, len(h), 7)
    place = ((h >> np.uint64(32)) * np.uint64(3 * n) >> np.uint64(32)).astype(int)
    assert strong and len(made) == len(set(made.tolist()))
    left = set(made.tolist())
    for i in range(n):
        for out in range(3):
            two = [3 * i + j for j in range(3) if j != out]
            if set(place.tolist()) >= {3 * i, 3 * i + 1, 3 * i + 2}:
                alone, _ = jaccard_join.subsets(h[np.isin(place, two)], len(h), 7)
                assert len(left & set(alone.tolist())) <= 1  # the one that leaves the third out, if the set gets so far
    for gone in range(0, len(h), 9):
        lost = left - set(jaccard_join.subsets(np.delete(h, gone), len(h), 7)[0].tolist())
        assert len(lost) <= 2


def test_shingles():
    assert len(shingle_hashes(b"", 5)) == len(shingle_hashes(b" \n", 5)) == 0
    assert (shingle_hashes(b"A b  c\td", 5) == shingle_hashes(b"a B c d", 5)).all() and len(shingle_hashes(b"a b c d e a b c d e", 5)) == 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (102, 100)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# 9


def test_packing(spark):
    docs = odd_docs(spark, ["lorem ipsum dolor " * n for n in range(1, 60)])
    got = packing.pack(docs).toPandas()
    tokenizer = packing.Encoder(packing.vocabulary_path()).tokenizer
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[(r.doc_id, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()))] += 1
    assert Counter((None if x != x else int(x), *map(int, r)) for x, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.values == np.concatenate([[0], g.length.cumsum().values[:-1]])).all() and g.length.sum() <= 4096
    assert packing.pack(empty_docs(spark)).count() == 0


def sequences_of(counts, runs):
    """The number of sequences of a plan, each filled gaplessly within the capacity and every piece placed once."""
    starts = {}
    for length, rank, n, first, at in runs.tolist():
        starts.setdefault(length, []).append((rank, n))
    assert {x: sum(n for _, n in r) for x, r in starts.items()} == {x: int(n) for x, n in enumerate(counts) if n}
    for r in starts.values():
        assert all(a + n == b for (a, n), (b, _) in zip(r, r[1:], strict=False)) and r[0][0] == 0
    total = int((runs[:, 3] + runs[:, 2]).max())
    filled, longest = np.zeros(total, np.int64), np.zeros(total, np.int64)
    for length, _, n, first, at in runs.tolist():
        filled[first : first + n] += length
        longest[first : first + n] = np.maximum(longest[first : first + n], at + length)
    assert (filled == longest).all() and filled.max() <= 4096 and filled.min() > 0
    return total


def test_plan_has_few_sequences():
    rng = np.random.default_rng(6)
    cases = [np.bincount(np.minimum(4096, rng.lognormal(m, s, n).astype(int) + 1), minlength=4097) for m, s, n in ((6.5, 1, 20_000), (7.5, 0.5, 20_000), (7.2, 0.7, 160_000), (7, 0.2, 20_000), (8, 0.4, 5_000))]
    cases += [np.bincount(rng.integers(1, 4097, 9_000), minlength=4097), np.eye(1, 4097, 1000, dtype=int)[0] * 7, np.bincount([4096] * 3 + [1] * 5, minlength=4097)]
    better = 0
    for counts in cases:
        plain = packing.Runs(counts)
        packing._best_fit(plain, 4096)
        got = sequences_of(counts, packing.plan_runs(counts))
        assert -(-int((counts * np.arange(4097)).sum()) // 4096) <= got <= plain.sequences
        better += got < plain.sequences
    assert better >= 3
    assert len(packing.plan_runs(np.zeros(4097, int))) == 0


def test_plan_of_the_documents_is_at_the_bound(spark):
    got = registry.QUERIES["op9_best_fit_packing"](spark, "/root/testdata/sf0.01").toPandas()
    assert got.sequence_id.nunique() == -(-got.length.sum() // 4096)


def test_encoder_equals_tokenizer_on_whole_texts():
    e = packing.Encoder(packing.vocabulary_path(), most=10)
    odd = ["a  b\t\tc\n x", "", "don't I'LL ÇA E\u0301 e\u0301 x\u00a0y \u3000z", "<|startoftext|> hi<|endoftext|>", "ΑΣ ΑΣ, Σ ÀÉ", "\u1100\u1161 n\u0303o ²³ ½ x\u200dy \U0001f600\U0001f600 a.b,c%% 中文字 ไทย", "a\x1cb \x85 c", "\u200bq 12 345 İx ǅ K"]
    for t, ids in zip(odd, e.encode(odd), strict=True):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


# 10


def test_gif_round_trip():
    random.seed(7)
    for data in (b"", b"a" * 100_000, bytes(random.randrange(256) for _ in range(192 * 600)), b"the cat sat on the mat. " * 9000):
        payload = gif.payload_of(data)
        assert len(payload) % 192 == 0 and len(payload) > 0 and payload.rstrip(b" ") == data.rstrip(b" ")
        assert b"".join(gif.drawn(f) for f in gif.read_gif(gif.write_gif(payload))) == payload


def small_gif(frames, size=2):
    """Frames (disposal, transparent index or None, left, top, width, height, indices) with codes of fixed width by clear codes."""
    out = b"GIF89a\x03\x00\x02\x00\xf1\x00\x00" + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for disposal, clear, left, top, w, h, values in frames:
        out += bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), 5, 0, clear or 0, 0, 0x2C, left, 0, top, 0, w, 0, h, 0, 0, size])
        bits = "".join(format(c, "03b")[::-1] for v in values for c in (4, v)) + format(5, "03b")[::-1]
        body = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        out += bytes([len(body)]) + body + b"\x00"
    return out + b"\x3b"


def test_gif_disposal_and_transparency(spark):
    data = small_gif([(1, None, 0, 0, 3, 2, [1] * 6), (3, None, 0, 0, 1, 1, [2]), (2, 0, 1, 0, 2, 1, [0, 3]), (1, None, 0, 1, 1, 1, [3])])
    frames = list(gif.read_gif(data))
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    assert frames[1].canvas[0].tolist() == [green, red, red]
    assert frames[2].canvas[0].tolist() == [red, red, blue]  # the second frame is gone, index 0 is transparent
    assert frames[3].canvas[0].tolist() == [red, [0, 0, 0], [0, 0, 0]] and frames[3].canvas[1, 0].tolist() == blue
    df = spark.createDataFrame([(1, data), (2, None), (3, b"GIF89a"), (4, data[:-20])], "id long, media binary")
    rows = gif.gif_frames(df, "id", "media").collect()
    assert [r.start_ms for r in rows if r.id == 1] == [0, 50, 100, 150] and all(sum(r.histogram) == 18 for r in rows if r.id == 1)
    assert not [r for r in rows if r.id == 2] and [r.error is not None for r in rows if r.id == 3] == [True]


def test_hostile_gif_is_an_error(spark):
    huge = b"GIF89a\xff\xff\xff\xff\x00\x00\x00" + b"\x3b"
    late = small_gif([(1, None, 0, 0, 3, 2, [1] * 6)])[:-1] + bytes([0x2C, 255, 255, 255, 255, 255, 255, 255, 255, 0, 2, 0, 0x3B])
    df = spark.createDataFrame([(1, bytearray(huge)), (2, bytearray(late)), (3, bytearray(small_gif([(1, None, 0, 0, 3, 2, [1] * 6)])))], "id long, media binary")
    rows = gif.gif_frames(df, "id", "media").collect()
    assert {(r.id, r.frame, "pixels" in (r.error or "")) for r in rows} == {(1, None, True), (2, 0, False), (2, None, True), (3, 0, False)}
    assert [r.error is None for r in gif.gif_frames(df.where("id = 3"), "id", "media", most_pixels=5).collect()] == [False]


def test_stored_texts(spark):
    docs = odd_docs(spark)
    got = gif.store_texts(docs).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    assert len(got) == sum(texts.values()) and gif.store_texts(empty_docs(spark)).count() == 0
    by_id = {d: t for d, t in texts}
    for r in got:
        payload = gif.payload_of((by_id[r.doc_id] or "").encode())
        assert (r.payload_sha256, r.tail_crc32, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(bytes(r.media)).hexdigest())


# pipeline


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    """The stages' filters give back the rows that they keep as they are, whatever the columns are called, and empty tables empty."""
    names = ["host", "path", "evidence", "own", "key", "row", "score", "accepted", "spans", "items", "n_words", "fold", "component"]
    docs = odd_docs(spark, [f"good clean prose number {i} with many plain words in it" for i in range(20)])
    docs = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    labels = spark.createDataFrame([(8 + i, int(i % 5 > 0), 0) for i in range(20)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "number 3 with many plain words in it"), (2, None)], "item_id long, text string")
    given = Counter(map(key_of, docs.collect()))
    for keep in (lambda d: quality.keep_accepted(d, labels), jaccard_join.keep_one, lambda d: decontaminate.without_windows(d, benchmark)):
        kept = keep(docs)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        assert not Counter(map(key_of, kept.collect())) - given
        assert keep(docs.limit(0)).count() == 0
    clean = decontaminate.without_windows(docs, benchmark)
    assert given - Counter(map(key_of, clean.collect())) == Counter({key_of(r): 1 for r in docs.where("text LIKE '%number 3 with%'").collect()})


def key_of(row):
    return repr(tuple(row))


def brute_keep_one(rows):
    """Rows that stay, by brute force over rows: one of each component, of the least id, null last; of equal rows any."""
    numbered = [Row(doc_id=i, text=r.text) for i, r in enumerate(rows)]
    component = {int(i): c for i, _, c in brute(numbered)}
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(component[i], []).append((r.doc_id is None, r.doc_id if r.doc_id is not None else 0, i))
    return [[rows[i] for n, d, i in g if (n, d) == min(g)[:2]] for g in groups.values()]


def agrees(kept, groups):
    """Whether exactly one of each group's candidates was kept, rows counted as often as they come."""
    left = Counter(map(key_of, kept))
    if sum(left.values()) != len(groups):
        return False
    for g in sorted(groups, key=len):
        k = next((key_of(r) for r in g if left[key_of(r)]), None)
        if k is None:
            return False
        left[k] -= 1
    return True


def test_near_duplicates_keep_rows_not_ids(spark):
    copy, near = "a text of some words that is copied here and there in full", "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, copy), (2, copy), (2, "a unique text that shares its id with the copy of another"), (None, copy), (None, "a unique text without any id at all"), (5, "two rows of one id and one text"), (5, "two rows of one id and one text"),
            (7, near), (6, near + " thirteen"), (None, "only null ids have this text"), (None, "only null ids have this text"), (8, ""), (8, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", i, "k", "r") for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, key string, row string")
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert agrees(got, brute_keep_one(docs.collect()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted(
        [(False, 1, copy), (False, 2, rows[2][1]), (True, 0, rows[4][1]), (False, 5, rows[5][1]), (False, 6, near + " thirteen"), (True, 0, rows[9][1]), (False, 8, ""), (False, 8, ""), (True, 0, "")]
    )
    assert jaccard_join.keep_one(empty_docs(spark)).count() == 0


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    passage = " ".join(max((b["text"] or "" for b in benchmark), key=len).split()[:14])
    some = [r for r in docs.limit(40).collect()]
    odd = [r.asDict() for r in some[:8]] + [{**r.asDict(), "doc_id": some[20].doc_id} for r in some[:8]] + [{**r.asDict(), "doc_id": None} for r in some[8:12]]
    odd += [{**r.asDict(), "doc_id": None, "text": f"{r.text} {passage}"} for r in some[12:16]] + [{**some[16].asDict(), "text": t} for t in (None, "", "Hello there")]
    docs = docs.unionByName(spark.createDataFrame([Row(**{c: x[c] for c in docs.columns}) for x in odd], docs.schema))  # shared, null and repeated ids
    steps = [docs]
    for _, stage in pipeline.STAGES:
        steps.append(scratch.materialize(stage(spark, steps[-1], SF), "step"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [s.collect() for s in steps]
    judge = {(r.doc_id, r.host, r.path, round(r.evidence, 12)): r.accepted for r in quality.classify(docs, labels).collect()}
    models = quality.train(docs, labels)
    good = [r for r in rows[0] if judge[(r.doc_id, r.source or "", r.lang or "", round(quality.evidence_of((r.text or "").encode(), models), 12))]]
    assert Counter(map(key_of, rows[1])) == Counter(map(key_of, good)) and 0 < len(good) < len(rows[0])
    assert agrees(rows[2], brute_keep_one(rows[1]))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for b in benchmark for w in [words(b["text"])] for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = [r for r in rows[2] if not any(tuple(w[i : i + n]) in windows for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1))]
    assert Counter(map(key_of, rows[3])) == Counter(map(key_of, clean)) and len(clean) < len(rows[2])
    assert Counter(r.doc_id for r in rows[4] if r.piece == 0) == Counter(r.doc_id for r in rows[3])
