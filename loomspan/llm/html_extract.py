"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The standard library's parser streams its events into block lines; what is no text of a
page (scripts, hidden elements, controls, inline adverts) is not read at all. Each line
has the ratio of its characters to its tags, up to `MOST`, times a weight between `SOFT`
and 1, which says what its tags and links mean; no weight is 0. The ratios are smoothed
along the lines of an article, and lines are returned where the smoothed ratio reaches
the threshold. Where a page names no article, the clusters of lines above the spread of
the smoothed ratios find its container, and what is outside it is weighed down likewise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.text import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup"
    " hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page, and those that hold menus, notices and the like, or forms.
NEVER = frozenset("applet audio button canvas datalist head iframe map math noembed noframes noscript object script select style svg template textarea title video".split())
AROUND = frozenset("aside dialog footer menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words of class and id values that name boilerplate.
NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs byline consent cookie cookies copyright disclaimer dropdown footer gdpr legal login masthead menu"
    " modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related share sharing sidebar signup skip social sponsor sponsored"
    " sponsors subscribe tags toolbar tracking widget widgets".split()
)
REMARKS = frozenset("comment comments discussion disqus replies reply respond responses".split())
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th"))}
LIMITS = frozenset("article aside blockquote body div dl footer form header main nav ol section table td th ul".split())
BODY = frozenset(("html", "body", "article", "main"))
#: Words beside those, and beside `header`, that leave a name as it is.
BESIDE = frozenset("area bar block bottom box button buttons container content fixed global group icon icons inner item items left link links list main message outer page panel posts right row section site small sticky top wrap wrapper".split())
SIGMA, RADIUS = 1.0, 2
#: The least weight, that of known boilerplate; that of text that is all links and of lines outside the article or container.
SOFT, LINKED, OUTSIDE = 1 / 400, 1 / 50, 1 / 200
#: Characters a tag beyond which a line is no more likely text; how many times its own ratio a line can have by its neighbours'.
MOST, LIFT = 100.0, 3.0
#: Smoothed characters a tag that main text has.
CUT = 1.0

_word = re.compile(r"[^a-z0-9]+")


class Line:
    __slots__ = ("text", "chars", "tags", "linked", "node", "soft", "form", "article", "named")

    def __init__(self, text: str, tags: int, linked: int, node: int, soft: bool, form: bool, article: tuple[int, bool]):
        self.text, self.chars, self.tags, self.linked, self.node, self.soft, self.form, self.article = text, len(text), tags, linked, node, soft, form, article[0]
        self.named = article[1]  # by an article, not a main alone


class Blocks(HTMLParser):
    """Collects block lines; keeps only the open elements and the lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, str]] = []  # name, container, what it holds: "" text, never, soft, remarks or form
        self.parents = [-1]
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.anchors = self.skip = self.soft = self.forms = 0  # the last four: open elements of a kind
        self.articles: list[tuple[int, bool]] = []  # for each open article or main: the outermost article around it, else the outermost main, and whether it is an article

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.open[-1][1] if self.open else 0, self.soft > 0, self.forms > 0, self.articles[-1] if self.articles else (0, False)))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def _what(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if tag in NEVER:
            return "never"
        found = "form" if tag == "form" else "soft" if tag in AROUND or tag == "header" and not self.articles else ""
        for key, value in attrs:
            if key == "hidden" or key == "style" and value and "display:none" in value.replace(" ", "").lower():
                return "never"
            if key == "role" and (value or "").lower() in ROLES:
                found = "soft"
            if key in ("class", "id") and value and tag not in ("html", "body"):
                for name in value.lower().split():
                    words = set(_word.split(name)) - {""}
                    if words & REMARKS and words <= REMARKS | BESIDE:
                        return "remarks"
                    marks = NAMES if self.articles else NAMES | {"header"}
                    if tag not in BODY and words & marks and words <= marks | BESIDE:
                        found = "soft"
        return "never" if found == "soft" and tag not in BLOCKS else found  # in a line: an advert, a button to share

    def _cut(self, tag: str) -> None:
        """Count a tag, which ends the line if it is a block's; what is not read has no lines."""
        if not self.skip:
            self.tags += 1
            if tag in BLOCKS and tag not in NEVER:
                self.flush()

    def _count(self, what: str, n: int) -> None:
        self.skip += n * (what == "never")
        self.soft += n * (what in ("soft", "remarks"))
        self.forms += n * (what == "form")

    def _pop(self) -> None:
        tag, _, what = self.open.pop()
        self._count(what, -1)
        self.anchors -= tag == "a"
        if tag in ("article", "main"):
            self.articles.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._cut(tag)
        if tag in VOID:
            self.parts.append(" ")
            return
        if ends := CLOSES.get(tag):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in ends:
                    while len(self.open) > i:
                        self._pop()
                    break
                if self.open[i][0] in LIMITS:
                    break
        what = self._what(tag, attrs)
        if tag in ("article", "main") and not what and self.soft and not self.articles and not self.skip and not any(w == "remarks" for *_, w in self.open):
            while self.soft:  # what should have been closed before the article
                self._pop()
        node = self.open[-1][1] if self.open else 0
        if tag in LIMITS:
            self.parents.append(node)
            node = len(self.parents) - 1
        self.open.append((tag, node, what))
        self._count(what, 1)
        self.anchors += tag == "a"
        if tag in ("article", "main"):
            around = self.articles[-1] if self.articles else None
            self.articles.append(around if around and (around[1] or tag == "main") else (node, tag == "article"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._cut(tag)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self._pop()
                return
            if tag not in BLOCKS and self.open[i][0] in LIMITS:
                return

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        self.parts.append(data)
        if self.anchors:
            self.linked += len(data)


def block_lines(html: str) -> tuple[list[Line], list[int]]:
    parser = Blocks()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # a marked section that the parser does not know; as a comment it is skipped
        parser = Blocks()
        parser.feed(html.replace("<![", "<!-- ["))
        parser.close()
    parser.flush()
    return parser.lines, parser.parents


def ratios_of(lines: list[Line], forms: bool = False) -> np.ndarray:
    """Characters by tags of each line, up to MOST, times its weight: what its element means, what of it is links, where it stands; `forms` lets forms hold text."""
    articles, named = any(x.article and not x.soft for x in lines), any(x.named and not x.soft for x in lines)
    out = np.empty(len(lines))
    for i, x in enumerate(lines):
        weight = 1.0 if x.article else max(LINKED, 1 - x.linked / x.chars)
        if articles and not x.article or named and not x.named:
            weight = min(weight, OUTSIDE)
        if x.soft or x.form and not forms:
            weight = SOFT
        out[i] = weight * min(x.chars / max(1, x.tags), MOST)
    return out


def smooth(ratios: np.ndarray, places: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing along the lines of each place (an article, or the rest); no line is lifted above LIFT times its own ratio, or sinks below a LIFTth of it."""
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    out = np.empty(len(ratios))
    for place in np.unique(places):
        at = np.flatnonzero(places == place)
        full, share = (np.convolve(x, kernel)[radius : radius + len(at)] for x in (ratios[at], np.ones(len(at))))
        out[at] = np.clip(full / share, ratios[at] / LIFT, ratios[at] * LIFT)
    return out


def clusters_of(smoothed: np.ndarray) -> list[list[int]]:
    """Runs of lines at or above the spread of the smoothed ratios."""
    cut = min(float(np.std(smoothed)), float(smoothed.max(initial=0)))
    out: list[list[int]] = []
    for i in np.flatnonzero(smoothed >= cut).tolist():
        if out and out[-1][-1] == i - 1:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def within_container(lines: list[Line], parents: list[int], clusters: list[list[int]]) -> np.ndarray:
    """Which lines stand in the smallest container that holds all of the clusters."""
    held = [0] * len(parents)
    for c in clusters:
        for i in c:
            held[lines[i].node] += 1
    for node in range(len(parents) - 1, 0, -1):
        held[parents[node]] += held[node]
    region = max(n for n in range(len(parents)) if held[n] == held[0])
    within = [False] * len(parents)
    for node in range(len(parents)):
        within[node] = node == region or node > 0 and within[parents[node]]
    return np.array([within[x.node] for x in lines])


def content_lines(lines: list[Line], parents: list[int]) -> list[Line]:
    """The lines whose smoothed ratio reaches the threshold, in page order.

    Without an article the container of the clusters stands for it. A page that has such
    lines in forms alone has its text there. Where no line that may be text is as long
    for its tags as the threshold asks, the longest is taken.
    """
    if not lines:
        return []
    places = np.array([x.article for x in lines])
    for forms in (False, True):
        smoothed = smooth(ratios_of(lines, forms), places)
        if not places.any():
            inside = within_container(lines, parents, clusters_of(smoothed))
            smoothed = np.where(inside, smoothed, smoothed * OUTSIDE)
        if (smoothed >= CUT).any():
            return [x for x, r in zip(lines, smoothed, strict=True) if r >= CUT]
    free = np.array([not x.soft for x in lines])
    top = smoothed[free].max(initial=0)
    return [x for x, r, f in zip(lines, smoothed, free, strict=True) if f and r >= top]


def main_text(html: str | None) -> str:
    return "\n".join(x.text for x in content_lines(*block_lines(html))) if html else ""


def extract_pages(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines (block lines of the whole page) of every page.

    A null or empty page, and one without main text, has an empty text. White space,
    non-breaking spaces included, becomes one space inside a block; `<br>` counts as
    white space. Rows repeat as they come in; other columns are left out.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts, counts = [], []
            for html in batch.column(2).to_pylist():
                lines, parents = block_lines(html) if html else ([], [])
                texts.append("\n".join(x.text for x in content_lines(lines, parents)))
                counts.append(len(lines))
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes, pa.array(counts, pa.int64())], ["page_id", "url", "text", "n_chars", "n_lines"])

    return df.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_lines long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op2_html_extract": op2_html_extract}
