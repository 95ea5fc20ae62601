"""Scalar text expressions: URLs, HTML, quality, identifiers. All are Catalyst columns."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Links of these hosts and endings are not read, and these hints in a link mean a scholarly text.
BINARY_ENDINGS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".ico", ".mp4", ".webm", ".mov", ".avi", ".mkv", ".mp3", ".wav", ".ogg",
    ".zip", ".tar", ".gz", ".xz", ".bz2", ".7z", ".rar", ".exe", ".dmg", ".iso", ".bin",
)
SCHOLARLY_HINTS = (
    "arxiv.org", "biorxiv.org", "medrxiv.org", "chemrxiv.org", "osf.io", "doi.org", "nature.com", "science.org", "sciencedirect.com", "cell.com", "pnas.org",
    "ncbi.nlm.nih.gov", "pubmed", "pmc", "wiley.com", "springer", "link.springer.com", "frontiersin.org", "journals.plos.org", "plos.org", "mdpi.com",
    "biomedcentral.com", "elifesciences.org", "jamanetwork.com", "thelancet.com", "nejm.org", "oup.com", "academic.oup.com", "tandfonline.com", "researchgate.net",
    "semanticscholar.org", "ssrn.com", "eprint.iacr.org", "acm.org", "ieee.org", "ieeexplore", "aeb", "acs.org", "rsc.org", "ntrs.nasa.gov", "europepmc.org",
)
# Names of the meta elements that give a title or a description, the first that has one wins.
TITLE_METAS = ("citation_title", "og:title", "dc.title")
DESCRIPTION_METAS = ("description", "og:description", "citation_abstract")
# The mark of a cut text, the control characters that no text should have, and those that are taken out of answers.
TRUNCATED = " …[truncated]"
DAMAGED = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\uFFFD]"
CONTROLS = "[\\x00-\\x08\\x0B-\\x1F\\x7F]"
USABLE_LENGTH = 50


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def usable(c: Column) -> Column:
    return F.length(strip(c)) >= USABLE_LENGTH


def damaged_chars(c: Column) -> Column:
    """Control characters other than tab and line ends, and replacement characters."""
    return F.length(c) - F.length(F.regexp_replace(c, DAMAGED, ""))


def unreadable(c: Column) -> Column:
    bad = damaged_chars(c)
    return (bad >= 32) & (bad > 0.01 * F.length(c))


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, "")


def trim_link(c: Column) -> Column:
    """Drop trailing punctuation and unbalanced closing brackets until nothing changes."""

    def unbalanced(u: Column, opening: str, closing: str) -> Column:
        count = lambda ch: F.length(u) - F.length(F.replace(u, F.lit(ch), F.lit("")))
        return u.endswith(closing) & (count(closing) > count(opening))

    def once(u: Column) -> Column:
        u = F.regexp_replace(u, "[.,;:!?\"'>]+$", "")
        return F.when(unbalanced(u, "(", ")") | unbalanced(u, "[", "]"), F.substring(u, F.lit(1), F.length(u) - 1)).otherwise(u)

    return F.aggregate(F.sequence(F.lit(0), F.length(c)), c, lambda u, _: once(u))


def links(c: Column) -> Column:
    """Distinct links of a text in order of appearance."""
    found = F.regexp_extract_all(c, F.lit(r"(?iU)(https?://[^\s<>\"'`]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, trim_link), lambda u: F.length(u) > 0))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_scholarly(url: Column) -> Column:
    low = F.lower(url)
    out = low.endswith(".pdf")
    for hint in SCHOLARLY_HINTS:
        out = out | low.contains(hint)
    return out


def is_binary(url: Column) -> Column:
    path = F.lower(url_path(url))
    out = F.lit(False)
    for ending in BINARY_ENDINGS:
        out = out | path.endswith(ending)
    return out


def on_host(url: Column, host: str) -> Column:
    at = F.lower(netloc(url))
    return (at == host) | at.endswith("." + host)


def title_from_url(url: Column) -> Column:
    """A title for a link without one: the last part of its path, else its host."""
    last = F.regexp_extract(F.regexp_replace(url_path(url), "/+$", ""), "([^/]*)$", 1)
    name = F.when(F.length(last) > 0, last).otherwise(netloc(url))
    title = strip(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), "[-_]", " "))
    return F.when(F.length(title) > 0, title).otherwise(netloc(url))


def truncated(c: Column, most: int) -> Column:
    """At most `most` characters, cut at a space and marked."""
    c = strip(c)
    cut = F.regexp_replace(F.substring(c, 1, most), " [^ ]*$", "")
    return F.when(F.length(c) > most, F.concat(cut, F.lit(TRUNCATED))).otherwise(c)


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references decoded; the built-in functions know none, so whole columns go through Arrow. Null stays null."""
    return texts.map(lambda t: html.unescape(t) if t and "&" in t else t, na_action="ignore")


# Fixed value: references that end as they should, and the ampersand's, which may lack its semicolon.
_CLOSED = re.compile(r"&amp;?|&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(T.StringType())
def unescaped_closed(texts: pd.Series) -> pd.Series:
    """As `unescaped`, but a name without its semicolon stays as it is, as where a text was cut; only an ampersand's may lack it."""
    one = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0] == "&amp" or m[0][1:] in html5 else m[0]
    return texts.map(lambda t: _CLOSED.sub(one, t) if t and "&" in t else t, na_action="ignore")


def meta_contents(page: Column, names: tuple[str, ...]) -> Column:
    """The first content that is not blank among the meta elements of these names, tried in order; character references as they stand."""
    metas = F.regexp_extract_all(page, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    name = lambda m: F.lower(F.regexp_extract(m, r"""(?is)\s(?:name|property)\s*=\s*["']([^"']*)["']""", 1))
    content = lambda m: F.regexp_extract(m, r"""(?is)\scontent\s*=\s*("[^"]*"|'[^']*')""", 1)
    pairs = F.transform(metas, lambda m: F.struct(name(m).alias("name"), strip(F.regexp_replace(content(m), r"(?s)^.|.$", "")).alias("content")))

    def named(n: str):
        return lambda x: (x["name"] == n) & (F.length(x["content"]) > 0)

    return F.coalesce(*(F.get(F.filter(pairs, named(n)), 0)["content"] for n in names))


def html_title(page: Column, closed: bool = False) -> Column:
    """The title element's text without tags, else that of the title metas; empty where there is none. With `closed` only references with semicolons are decoded."""
    title = strip(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", ""))
    return strip((unescaped_closed if closed else unescaped)(F.when(F.length(title) > 0, title).otherwise(F.coalesce(meta_contents(page, TITLE_METAS), F.lit("")))))


def html_description(page: Column) -> Column:
    """The description that the metas give; null where there is none."""
    return strip(unescaped(meta_contents(page, DESCRIPTION_METAS)))


def html_text(page: Column, closed: bool = False) -> Column:
    """Text of a page by patterns alone: scripts and tags out, references decoded (with `closed`, those with semicolons), lines stripped, at most one blank line together."""
    c = F.regexp_replace(page, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1>", " ")
    c = (unescaped_closed if closed else unescaped)(F.regexp_replace(c, "<[^>]+>", " "))
    c = F.regexp_replace(c, r"[ \t\r\f\x0B]+", " ")
    c = F.regexp_replace(c, "[\u001c\u001d\u001e\u0085\u2028\u2029]", "\n")
    c = F.regexp_replace(c, r"(?U)[\s\x1F&&[^\n]]*\n[\s\x1F&&[^\n]]*", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def described(text: Column, description: Column) -> Column:
    """The text with its description before it, unless it holds that already."""
    return F.when(description.isNotNull() & ~F.contains(text, description), F.concat(F.lit("Description: "), description, F.lit("\n\n"), text)).otherwise(text)


def is_pdf(url: Column, content_type: Column) -> Column:
    """By the content type, else by the ending of the path; nulls count as empty."""
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf")) | F.lower(F.coalesce(url_path(url), F.lit(""))).endswith(".pdf")


def is_citation(url: Column) -> Column:
    """Whether a link can be cited: http or https, a host, and no line ends or angle brackets; null is not one."""
    return F.coalesce(F.lower(url).rlike(r"^https?://[^/?#]") & ~url.rlike(r"[\r\n<>]"), F.lit(False))


def is_output_name(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"), F.lit(False))


def is_safe_path(c: Column) -> Column:
    """A relative path without hidden, parent or empty parts that ends in .pdf in any case."""
    return F.coalesce((F.length(c) > 0) & ~c.rlike(r"^/|(^|/)\.|//|[\r\n\x00]|/$") & F.lower(c).endswith(".pdf"), F.lit(False))


def is_pdf_content(content: Column) -> Column:
    """Whether the mark of a PDF is among the first 1024 bytes."""
    return F.coalesce(F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0, F.lit(False))


def failure_kind(content: Column) -> Column:
    """Why a PDF gave no text, as far as its bytes alone tell; a null content could not be read."""
    plain = F.decode(content, "ISO-8859-1")
    return (
        F.when(content.isNull(), "source_unavailable").when(F.octet_length(content) == 0, "empty_file").when(~is_pdf_content(content), "not_pdf").when(F.contains(plain, F.lit("/Encrypt")), "password_required")
        .when(~plain.rlike(r"/Type\s*/Page\b"), "no_readable_pages").otherwise("readable_pdf_extraction_failed")
    )


def percent_decoded(c: Column) -> Column:
    """Percent codes decoded, a plus as it stands; a text with a broken code stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def repaired_utf8(content: Column) -> tuple[Column, Column]:
    """(text, whether it was repaired): bytes as UTF-8, with the replacement character for what is none."""
    text = F.make_valid_utf8(content.cast("string"))
    return text, ~F.is_valid_utf8(content.cast("string"))


def collection_fields(path: Column, digest: Column, base: str) -> dict[str, Column]:
    """The fields that a collection keeps of a document, by its path key."""
    shown = percent_decoded(path)
    return {"relative_path": shown, "filename": F.element_at(F.split(shown, "/"), -1), "source_url": F.concat(F.lit(base), path), "sha256": digest}


def human_size(c: Column) -> Column:
    """A size with a unit and one decimal, a half to the even digit; bytes as they are."""
    shown = lambda unit: F.format_string("%.1f", F.bround(c / unit, 1))
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1 << 20, F.concat(shown(1 << 10), F.lit(" KB")))
        .when(c < 1 << 30, F.concat(shown(1 << 20), F.lit(" MB")))
        .otherwise(F.concat(shown(1 << 30), F.lit(" GB")))
    )


def markdown_label(c: Column) -> Column:
    """Escaped for the brackets of a Markdown link; each line end becomes one space."""
    return F.translate(F.regexp_replace(c, r"([\\\[\]])", r"\\$1"), "\r\n", "  ")


# A whole document in one fence, after a first line or not; a fence that opens one, and one that ends it.
WRAPPED = r"(?s)\A(?:[^\n]*\n\n?)?```(?:markdown|md)?\s*\n(.*)\n```\z"
OPENING, CLOSING = r"\A```[a-zA-Z]*\s*\n", r"\n```\z"


def unfenced(c: Column) -> Column:
    """A document without the code fence that wraps it whole, or that only its beginning has; fences inside stay. Null stays null."""
    c = strip(c)
    inner = strip(F.regexp_extract(c, WRAPPED, 1))
    cut = strip(F.regexp_replace(F.regexp_replace(c, OPENING, ""), CLOSING, ""))
    return F.when(inner.startswith("#"), inner).when(c.startswith("```"), cut).otherwise(c)


def path_key(path: Column) -> Column:
    """Percent-encoded path that keeps slashes."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def output_path(digest: Column, stem: Column) -> Column:
    name = F.substring(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "-"), 1, 80)
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), name, F.lit("-"), digest, F.lit(".md"))


def remote_name(key: Column, digest: Column, suffix: Column) -> Column:
    return F.concat(F.substring(F.sha2(key, 256), 1, 16), F.lit("-"), F.substring(digest, 1, 16), suffix)


def revision(recipe: str, digest: Column) -> Column:
    """Identity of derived data: any change of recipe or content makes another."""
    return F.sha2(F.concat(F.lit(recipe), digest), 256)


def token_count(c: Column) -> Column:
    """Words and single marks, the default tokens of the offline tokenizer."""
    return F.size(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1)))


def auto_link(c: Column) -> Column:
    """Words that begin like a URL as Markdown links; `www.` leads to https."""
    c = F.regexp_replace(c, "(^|[ \\t\\n\\r\\f])(www\\.[^ \\t\\n\\r\\f]*)", "$1[$2](https://$2)")
    return F.regexp_replace(c, "(^|[ \\t\\n\\r\\f])((?:https?|ftp)://[^ \\t\\n\\r\\f]*)", "$1[$2]($2)")
