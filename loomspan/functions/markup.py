"""The text of a page's article by the standard library's parser, for pages that patterns alone read badly."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.text import TRUNCATED

# Elements whose content is not read, and those that hold the main text, the first kind that occurs wins.
LEFT_OUT = frozenset(("script", "style", "noscript", "template", "svg", "form", "nav", "footer", "header", "aside", "button", "iframe"))
MAIN = ("article", "main", "role")
_GAPS = re.compile(r"[ \t\r\f\v]+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    """Text nodes of the whole page and of the first element of each main kind."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.out = 0  # open elements that are left out
        self.parts: dict[str, list[str]] = {"page": []}
        self.within: dict[str, int] = {}  # main kinds that are being read: the depth at which they end

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        self.open.append(tag)
        self.out += tag in LEFT_OUT
        if not self.out:
            role = any(k == "role" and v == "main" for k, v in attrs)
            for kind in ({tag} & {"article", "main"}) | ({"role"} if role else set()):
                if kind not in self.parts:
                    self.parts[kind] = []
                    self.within[kind] = len(self.open)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.out -= last in LEFT_OUT
                for kind, depth in list(self.within.items()):
                    if depth > len(self.open):
                        del self.within[kind]
                if last == tag:
                    return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        return

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.parts["page"].append(data)
            for kind in self.within:
                self.parts[kind].append(data)


def read(page: str | None, most: int | None = None) -> str:
    """Text nodes apart by spaces, line by line, at most one blank line together; cut at a space beyond `most` characters, and marked."""
    reader = _Reader()
    try:
        reader.feed(page or "")
        reader.close()
    except AssertionError:  # a marked section that the parser does not know
        pass
    kept: list[str] = []
    for line in " ".join(next((reader.parts[k] for k in MAIN if k in reader.parts), reader.parts["page"])).splitlines():
        words = " ".join(w for w in _GAPS.split(line.strip()) if w)
        if words or kept and kept[-1]:
            kept.append(words)
    text = "\n".join(kept).rstrip("\n")
    if most is None or len(text) <= most:
        return text
    edge = text.rfind(" ", 0, most)
    return text[: most if edge < 0 else edge] + TRUNCATED


@F.pandas_udf(T.StringType())
def main_text(pages: pd.Series) -> pd.Series:
    """The text of each page; a null or empty page has an empty one."""
    return pages.map(read)
