"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence is a logistic model of its words and of binned shape
statistics, fitted on a bounded sample of labelled documents. The mean evidence of its
host, shrunk towards the global mean, and of its path within the host, shrunk towards
the host's, are added on the log-odds scale. A labelled document tells its sites its label
instead of its evidence, and no document counts in the sites that judge it. How strongly sites are shrunk is estimated
from how much they differ (method of moments), by grouped sums alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.llm.text import ALNUM, slices, utf8

MEASURES = 9
#: Labelled documents that the model is fitted on, at most; the least by a hash of their id.
SAMPLE = 6_000
WORDS = 200
BINS = 8
RIDGE = 1.0
THRESHOLD = 0.5

_SYMBOLS = bytes(c for c in b"!#$%&*+/<=>@\\^_`|~")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def measures(text: bytes, words: list[bytes]) -> list[float]:
    """Shape statistics of a text, all between 0 and 1 but for lengths."""
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]

    def share(chars: bytes) -> float:
        return (len(text) - len(text.translate(None, chars))) / size

    return [
        np.log1p(len(words)), len(counts) / n, max(counts.values(), default=0) / n, share(_SYMBOLS), share(_UPPER), share(_DIGITS),
        sum(map(len, words)) / n, len(set(lines)) / max(1, len(lines)), (len(words) - len(counts)) / np.sqrt(n),
    ]


class Model:
    """Weights of bins and words for one label."""

    def __init__(self, cuts: np.ndarray, words: dict[bytes, float], bins: np.ndarray, bias: float):
        self.cuts, self.words, self.bins, self.bias = cuts, words, bins, bias

    def log_odds(self, stats: list[float], words: set[bytes]) -> float:
        out = self.bias
        for i, x in enumerate(stats):
            out += self.bins[i, np.searchsorted(self.cuts[i], x, "right")]
        for w in self.words.keys() & words:
            out += self.words[w]
        return float(out)


def fit(stats: np.ndarray, chosen: list[bytes], present: np.ndarray, y: np.ndarray, bins: int = BINS, ridge: float = RIDGE) -> Model:
    """Ridge-penalised logistic regression on the bins of all statistics and the presence (rows by words) of the chosen words.

    Without both labels in the sample the model is the smoothed share of ones.
    """
    n, k = len(y), MEASURES
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Model(np.zeros((k, bins - 1)), {}, np.zeros((k, bins)), bias)
    cuts = np.stack([np.quantile(stats[:, i], np.linspace(0, 1, bins + 1)[1:-1]) for i in range(k)])
    x = np.zeros((n, k * bins + len(chosen) + 1), np.float32)
    x[:, -1] = 1
    for i in range(k):
        x[np.arange(n), i * bins + np.searchsorted(cuts[i], stats[:, i], "right")] = 1
    x[:, k * bins : -1] = present
    beta = np.zeros(x.shape[1])
    beta[-1] = bias
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-4:
            break
    return Model(cuts, {w: float(beta[k * bins + i]) for i, w in enumerate(chosen)}, beta[: k * bins].reshape(k, bins), float(beta[-1]))


def telling(ones: Column, both: Column, positive: Column, total: Column) -> Column:
    """How far a word's documents with the label are from their expected number."""
    expected = both * positive / total
    return (ones - expected) ** 2 / (expected + 1) + (ones - expected) ** 2 / (both - expected + 1)


def evidence_of(text: bytes, models: tuple[Model, Model]) -> float:
    """The probability that the text is of quality and not toxic."""
    words = text.translate(ALNUM).split()
    stats, kinds = measures(text, words), set(words)
    good, toxic = (1 / (1 + np.exp(-np.clip(m.log_odds(stats, kinds), -30, 30))) for m in models)
    return float(good * (1 - toxic))


def labels_of(labels: DataFrame) -> DataFrame:
    """(doc_id, quality, toxic) once for each labelled id; of several labels the greatest holds, and null ones are left out."""
    whole = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return whole.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = WORDS) -> tuple[Model, Model]:
    """Models of quality and of toxicity from at most `sample` labelled documents, one row for each; ids may be of any type that both tables share.

    The driver gets their statistics and, for the `most` most telling words, whether they
    occur; words are counted in tasks, so neither long texts nor repeated ids make that more.
    """
    chosen = labels_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality", "toxic")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats, words = [], []
            for text in utf8(batch.column(1)):
                w = text.translate(ALNUM).split()
                stats.append(measures(text, w))
                words.append(sorted(set(w)))
            ones = [pa.array((batch.column(i).to_numpy(zero_copy_only=False) > 0).astype(np.int64)) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.binary())), *ones], ["doc_id", "stats", "words", "quality", "toxic"])

    made = rows.mapInArrow(features, f"doc_id {kind}, stats array<double>, words array<binary>, quality long, toxic long")
    # of several rows of one id any one: the least by its content, found before the shuffle where it can be
    one = made.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("stats", "words"), "stats", "words", "quality", "toxic")).alias("r"))
    one = scratch.materialize(one.select("doc_id", "r.stats", "r.words", "r.quality", "r.toxic"), "features")
    each = one.select(F.explode("words").alias("word"), "quality", "toxic").groupBy("word").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))
    each = scratch.materialize(each.where("n >= 3"), "telling")
    whole = one.agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("quality"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    picked = []
    for label in ("quality", "toxic"):
        score = telling(F.col(label), F.col("n"), F.lit(float(whole[label])), F.lit(float(max(1, whole.n))))
        picked.append([bytes(r.word) for r in each.orderBy(score.desc(), "word").limit(most).collect()])

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [{w: i for i, w in enumerate(words)} for words in picked]
        for batch in batches:
            sets = batch.column(2).to_pylist()
            at = [pa.array([[p[w] for w in words if w in p] for words in sets], pa.list_(pa.int32())) for p in places]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *at, batch.column(3), batch.column(4)], ["doc_id", "stats", "a", "b", "quality", "toxic"])

    got = one.mapInArrow(presence, f"doc_id {kind}, stats array<double>, a array<int>, b array<int>, quality long, toxic long").orderBy("doc_id").toArrow()
    stats = np.array(got.column("stats").to_pylist(), float).reshape(got.num_rows, MEASURES)
    models = []
    for column, label, words in (("a", "quality", picked[0]), ("b", "toxic", picked[1])):
        present = np.zeros((got.num_rows, len(words)), np.float32)
        for r, at in enumerate(got.column(column).to_pylist()):
            present[r, at] = 1
        models.append(fit(stats, words, present, got.column(label).to_numpy().astype(float)))
    return tuple(models)


def evidence(spark: SparkSession, models: tuple[Model, Model]) -> "Column":
    handle = spark.sparkContext.broadcast(models)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([evidence_of((t or "").encode(), handle.value) for t in texts], dtype=float)

    return run


#: The most prior observations that a group's prior is worth: groups that do not differ more than by chance are then told by their prior alone.
STRONGEST = 1e6


def _strength(mean: Column, between: Column) -> Column:
    """Prior observations that a group's prior is worth, from the variance between groups' means."""
    return F.least(F.lit(STRONGEST), F.greatest(F.lit(1.0), mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1))


def with_labels(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, evidence, ...) with `own`, what each says of its site: its label where it has one, else its evidence."""
    known = labels_of(labels).select(F.col("doc_id").alias("__id"), ((F.col("quality") > 0) & (F.col("toxic") <= 0)).cast("double").alias("__truth"))
    # rows without an id have no label; they take no part in the join, where they would be one hot key
    named = scored.where("doc_id IS NOT NULL").join(known, F.col("doc_id") == F.col("__id"), "left").withColumn("own", F.coalesce("__truth", "evidence")).drop("__id", "__truth")
    return named.unionByName(scored.where("doc_id IS NULL").withColumn("own", F.col("evidence")))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, n, s, hn, hs, k1, k2, prior, host_posterior, path_posterior) for each path of each host.

    scored: host, path, evidence, and `own` where that is another. n and s are the path's rows and their sum, hn and hs the
    host's; k1 and k2 the strengths of the global and the host's prior. Sums by path feed those by host, and these the whole;
    no group's rows are gathered.
    """
    own = F.col("own") if "own" in scored.columns else F.col("evidence")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(own).alias("s"), F.sum(own**2).alias("q"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.count("*").alias("hk"))
    whole = hosts.agg(F.sum("hn").alias("N"), F.sum("hs").alias("S"), F.sum("hq").alias("Q"), F.count("*").alias("K"), F.sum(F.col("hs") ** 2 / F.col("hn")).alias("B"), F.sum(F.col("hn") ** 2).alias("N2"))
    inner = paths.join(hosts.select("host", "hk"), "host").agg(F.sum(F.col("s") ** 2 / F.col("n")).alias("PB"), F.count("*").alias("PK"))
    both = whole.crossJoin(inner)  # one row each
    within = (F.col("Q") - F.col("B")) / F.greatest(F.col("N") - F.col("K"), F.lit(1))
    spread = (F.col("B") - F.col("S") ** 2 / F.col("N") - (F.col("K") - 1) * within) / F.greatest(F.col("N") - F.col("N2") / F.col("N"), F.lit(1.0))
    rest = (F.col("Q") - F.col("PB")) / F.greatest(F.col("N") - F.col("PK"), F.lit(1))
    deeper = (F.col("PB") - F.col("B") - (F.col("PK") - F.col("K")) * rest) / F.greatest(F.col("N") * (1 - F.col("K") / F.col("PK")), F.lit(1.0))
    prior = F.col("S") / F.col("N")
    constants = both.select(prior.alias("prior"), _strength(prior, spread).alias("k1"), _strength(prior, deeper).alias("k2"))
    joined = paths.join(hosts.select("host", "hn", "hs"), "host").crossJoin(F.broadcast(constants))
    host = (F.col("hs") + F.col("k1") * F.col("prior")) / (F.col("hn") + F.col("k1"))
    joined = joined.withColumn("host_posterior", host)
    path = (F.col("s") + F.col("k2") * F.col("host_posterior")) / (F.col("n") + F.col("k2"))
    return joined.select("host", "path", "n", "s", "hn", "hs", "k1", "k2", "prior", "host_posterior", path.alias("path_posterior"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def combine(scored: DataFrame, sites: DataFrame) -> DataFrame:
    """Add prior, host_posterior, path_posterior, score and accepted to rows with host, path, evidence and `own`.

    A row is left out of its own site: the posteriors that it gets are those of the other rows.
    """
    joined = scored.join(sites.drop("host_posterior", "path_posterior"), ["host", "path"])
    host = (F.col("hs") - F.col("own") + F.col("k1") * F.col("prior")) / (F.col("hn") - 1 + F.col("k1"))
    joined = joined.withColumn("host_posterior", host)
    path = (F.col("s") - F.col("own") + F.col("k2") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("k2"))
    joined = joined.withColumn("path_posterior", path).drop("n", "s", "hn", "hs", "k1", "k2")
    odds = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(F.col("prior"))
    return joined.withColumn("score", 1 / (1 + F.exp(-odds))).withColumn("accepted", F.col("score") >= THRESHOLD)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", known: DataFrame | None = None) -> DataFrame:
    """A row for each document: doc_id, host, path, evidence, prior, host_posterior, path_posterior, score, accepted.

    Null hosts and paths are sites of their own, named by the empty text; a null text
    counts as empty. Repeated rows are judged alike. Labels without a document, or null,
    are ignored, and of several labels for one document the greatest holds. Without
    labels every document has even odds and is accepted or not by them alone. `known`
    are the labels that count for the sites, if others than those of the models.
    """
    models = train(docs, labels)
    scored = docs.select("doc_id", F.coalesce(F.col(host), F.lit("")).alias("host"), F.coalesce(F.col(path), F.lit("")).alias("path"), evidence(docs.sparkSession, models)(F.col("text")).alias("evidence"))
    scored = scratch.materialize(scored, "evidence")
    scored = scratch.materialize(with_labels(scored, labels if known is None else known), "sites")
    return combine(scored, site_posteriors(scored)).select("doc_id", "host", "path", "evidence", "prior", "host_posterior", "path_posterior", "score", "accepted")


def keep_accepted(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows that the classifier accepts, with their own columns and no others."""
    judge = evidence(docs.sparkSession, train(docs, labels))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    scored = docs.select("doc_id", F.coalesce(F.col(host), F.lit("")).alias("host"), F.coalesce(F.col(path), F.lit("")).alias("path"), judge(F.col("text")).alias("evidence"), F.monotonically_increasing_id().alias("key"), row)
    scored = scratch.materialize(scored, "evidence")  # with the rows, so that no text is judged twice
    told = scratch.materialize(with_labels(scored.drop("row"), labels), "sites")
    sites = scratch.materialize(site_posteriors(told), "posteriors")
    gone = scratch.materialize(combine(told, sites).where("NOT accepted").select("key"), "rejected")
    return scored.join(gone, "key", "left_anti").select("row.*")


def accuracy(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """One row (n, right, base, toxic, caught): labelled documents of a held-out fold by crc32 of their id, those judged right, the share of the more
    frequent truth, and the toxic ones with those of them that are rejected. Neither models nor sites know the fold's labels."""
    own = labels_of(labels).withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds)
    rest = own.where("fold <> 0").drop("fold")
    judged = classify(docs, rest, known=rest).select("doc_id", "accepted").dropDuplicates(["doc_id"])
    both = judged.join(own.where("fold = 0"), "doc_id").withColumn("truth", (F.col("quality") > 0) & (F.col("toxic") <= 0))
    good = F.count_if("truth") / F.count("*")
    return both.agg(
        F.count("*").alias("n"), F.count_if(F.col("accepted") == F.col("truth")).alias("right"), F.greatest(good, 1 - good).alias("base"),
        F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if((F.col("toxic") > 0) & ~F.col("accepted")).alias("caught"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op7_quality": op7_quality}
