"""URL filter: a weighted vocabulary searched by an Aho-Corasick automaton.

Strict and soft terms count only where neither neighbour is a letter or digit of
ASCII. One strict term rejects a URL; so do soft terms whose distinct weights sum to
the limit, which no single one has. Host and path rules come first; they are plain Catalyst expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.text import LOWER, UPPER

#: Terms that reject a URL alone.
STRICT = (
    "bestiality", "blackjack", "camgirl", "camgirls", "casino", "casinos", "cialis", "escort", "escorts", "erotica", "fetish", "hardcore", "hentai", "levitra", "milf", "nsfw", "onlinecasino",
    "porn", "porno", "pornhub", "pornography", "roulette", "sexcam", "sportsbook", "viagra", "warez", "xhamster", "xnxx", "xvideos", "xxx",
)
#: Terms that together reject a URL, by what they weigh: 1 where plain pages have them too, 2 where few do.
SOFT = {
    "adult": 2, "ads": 2, "affiliate": 1, "bet": 2, "bets": 2, "betting": 2, "bingo": 2, "bonus": 1, "buy": 1, "cash": 1, "cheap": 1, "clickbait": 2, "coupon": 1, "coupons": 1, "crack": 1, "cracked": 2,
    "credit": 1, "dating": 2, "deal": 1, "deals": 1, "diet": 1, "discount": 1, "download": 1, "earn": 1, "farm": 1, "forex": 2, "free": 1, "gambling": 2, "girls": 1, "hack": 1, "hot": 1, "jackpot": 2,
    "keygen": 2, "kinky": 2, "loan": 1, "loans": 2, "lottery": 2, "lotto": 2, "mature": 1, "money": 1, "naked": 2, "nude": 2, "nudes": 2, "offer": 1, "payday": 2, "pharma": 1, "pharmacy": 1, "pills": 2,
    "poker": 2, "popup": 1, "promo": 1, "replica": 1, "rx": 1, "serial": 1, "sex": 2, "sexy": 2, "singles": 1, "slot": 1, "slots": 2, "spam": 2, "spin": 1, "steroids": 2, "teen": 1, "torrent": 1, "torrents": 2,
    "track": 1, "tracker": 1, "vip": 1, "wager": 2, "webcam": 1, "weightloss": 2, "win": 1, "winner": 1, "x": 1,
}
#: The weight at which distinct soft terms reject a URL; no soft term has it alone.
SOFT_LIMIT = 3
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER.decode(), LOWER.decode())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        top, slash, rest = text.partition("/")
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def automaton(strict: tuple, soft: dict) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in (*strict, *soft):
        found.add_word(term, (term, len(term)))
    if len(found):
        found.make_automaton()
    return found


def term_hits(text: str, found: ahocorasick.Automaton) -> set[str]:
    """Distinct terms that occur in the lower-cased text between boundaries."""
    hits = set()
    for end, (term, n) in found.iter(text):
        start = end - n + 1
        if (start == 0 or text[start - 1] not in _ALNUM) and (end + 1 == len(text) or text[end + 1] not in _ALNUM):
            hits.add(term)
    return hits


def judge_urls(
    df: DataFrame, column: str = "url", strict: tuple = STRICT, soft: dict | None = None, soft_limit: int = SOFT_LIMIT, rules: tuple = RULES
) -> DataFrame:
    """Add host, path, rule, verdict, strict_hits, soft_hits and soft_weight to every row.

    Null and empty URLs, and those without `://`, have an empty host and path; a URL
    without hits is allowed. Rows repeat as they come in. A column of the input that
    has one of the new names is replaced.
    """
    soft = SOFT if soft is None else soft
    strict_set = frozenset(strict)

    @F.pandas_udf("strict_hits long, soft_hits long, soft_weight long")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(strict, soft)  # one for each task; the vocabulary is a parameter of fixed size
        for url in urls:
            rows = []
            for text in url:
                terms = term_hits(text, found) if text and len(found) else ()
                gentle = [t for t in terms if t not in strict_set]
                rows.append((len(terms) - len(gentle), len(gentle), sum(soft[t] for t in gentle)))
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_hits", "soft_weight"])

    host, path = host_and_path(F.col(column))
    df = df.withColumns({"host": host, "path": path, "__hits": hits(ascii_lower(F.col(column)))})
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("__hits.strict_hits") > 0) | (F.col("__hits.soft_weight") >= soft_limit), "block").otherwise("allow")
    df = df.withColumns({"rule": rule, "verdict": F.coalesce(says, method)})
    return df.withColumns({k: F.col(f"__hits.{k}") for k in ("strict_hits", "soft_hits", "soft_weight")}).drop("__hits")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def _sql() -> str:
    def occurs(term: str) -> str:
        return f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') THEN 1 ELSE 0 END"

    strict = " + ".join(occurs(t) for t in STRICT)
    soft = " + ".join(occurs(t) for t in SOFT)
    weight = " + ".join(f"{SOFT[t]} * {occurs(t)}" for t in SOFT)
    rules = sorted(RULES, key=lambda r: -len(r[1]))

    def cases(i: int) -> str:
        out = []
        for r in rules:
            top, slash, rest = r[1].partition("/")
            out.append(f"WHEN (host = '{top}' OR suffix(host, '.{top}')) AND prefix(path, '{slash}{rest}') THEN '{r[i]}'")
        return " ".join(out)

    up, low = UPPER.decode(), LOWER.decode()
    return f"""
    WITH a AS (SELECT page_id, coalesce(translate(url, '{up}', '{low}'), '') AS u,
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{up}', '{low}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    c AS (SELECT *, CASE {cases(1)} ELSE NULL END AS rule, CASE {cases(0)} ELSE NULL END AS says,
        CAST({strict} AS BIGINT) AS strict_hits, CAST({soft} AS BIGINT) AS soft_hits, {weight} AS soft_weight FROM b)
    SELECT page_id, host, path, rule, coalesce(says, CASE WHEN strict_hits > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
        strict_hits, soft_hits FROM c"""


SQL = {"op5_url_filter": _sql()}
QUERIES = {"op5_url_filter": op5_url_filter}
