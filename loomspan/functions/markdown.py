"""Pages as Markdown: one pass over the parser's events, with a stack of open blocks.

Each block element opens a frame that gathers finished lines; when it ends, the frame is
rendered into lines of its parent, which indents or quotes them. Inline marks are put into
the open run of text, which becomes lines when a block begins or ends.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.markup import _VOID, LEFT_OUT
from loomspan.functions.text import TRUNCATED

# Elements that are blocks of their own, and the marks of inline ones.
_HEADS = {f"h{i}": "#" * i + " " for i in range(1, 7)}
_BLOCKS = frozenset("address article body center dd details div dl dt fieldset figcaption figure hgroup html main p section summary".split())
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~"}
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_SPECIAL = re.compile(r"([\\`*_\[\]<>])")
_LEADS = re.compile(r"^(#{1,6}(?= )|[-+](?= )|\d+(?=[.)] ))")


class _Frame:
    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs = tag, attrs
        self.blocks: list[list[str]] = []  # finished blocks, each its lines
        self.number = 0


class _Writer(HTMLParser):
    def __init__(self, origin: str):
        super().__init__(convert_charrefs=True)
        self.origin = origin
        self.stack = [_Frame("", {})]
        self.open: list[str] = []
        self.text: list[str] = []
        self.links: list[tuple[int, str, bool]] = []  # where an open link's text begins, its target, whether it is in code
        self.marks: list[tuple[int, str]] = []
        self.out = self.pre = self.code = 0
        self.rows: list[list[str]] | None = None

    # text

    def handle_data(self, data: str) -> None:
        if self.out or self.stack[-1].tag in ("table", "tr", "ul", "ol") and not data.strip():
            return
        if self.pre or self.code:
            self.text.append(data)
        else:
            self.text.append(_SPECIAL.sub(r"\\\1", _SPACE.sub(" ", data)))

    def _taken(self) -> str:
        """The open run of text; marks and links that are open end with it."""
        while self.links:
            self._end_link()
        while self.marks:
            self._end_mark()
        out, self.text = "".join(self.text), []
        return out

    def flush(self) -> None:
        """Make the open text a block of the open frame."""
        if self.pre:
            return
        text = self._taken()
        lines = [re.sub(" +", " ", line).strip() for line in text.split("\n")]
        lines = [_LEADS.sub(lambda m: m[1][:-1] + "\\" + m[1][-1] if m[1][-1].isalnum() else "\\" + m[1], line) if self.stack[-1].tag not in _HEADS else line for line in lines]
        lines = [re.sub(r"^(\d*)\\(\d)(?=[.)] )", r"\1\2\\", line) for line in lines]
        lines = [line for line in lines if line]
        if lines:
            self.stack[-1].blocks.append([line + "  " for line in lines[:-1]] + lines[-1:])

    # inline

    def _end_mark(self) -> None:
        at, mark = self.marks.pop()
        inner = "".join(self.text[at:])
        del self.text[at:]
        body = inner.strip()
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        self.text.append(f"{lead}{mark}{body}{mark}{tail}" if body else inner)

    def _end_link(self) -> None:
        at, target, _ = self.links.pop()
        inner = "".join(self.text[at:])
        del self.text[at:]
        body = _SPACE.sub(" ", inner).strip()
        lead, tail = " " * inner.startswith(" "), " " * inner.endswith(" ")
        self.text.append(f"{lead}[{body}]({target}){tail}" if body and target else inner)

    def _target(self, link: str | None) -> str:
        """An absolute link; a script's is none."""
        try:
            made = urljoin(self.origin, (link or "").strip())
        except ValueError:
            return ""
        if not made or made.lower().startswith(("javascript:", "data:")):
            return ""
        return re.sub(r"[\s()<>]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), made)

    # events

    def handle_starttag(self, tag: str, attrs: list) -> None:
        known = dict(attrs)
        if tag not in _VOID:
            self.open.append(tag)
            self.out += tag in LEFT_OUT or tag == "title"
        if self.out:
            return
        if tag == "br":
            self.text.append("\n")
        elif tag == "hr":
            self.flush()
            self.stack[-1].blocks.append(["---"])
        elif tag == "img":
            if target := self._target(known.get("src")):
                self.text.append(f"![{_SPECIAL.sub(r'\\\1', _SPACE.sub(' ', known.get('alt') or '').strip())}]({target})")
        elif tag == "a":
            self.links.append((len(self.text), self._target(known.get("href")), bool(self.code)))
        elif tag in _MARKS and not self.pre and not self.code:
            self.marks.append((len(self.text), _MARKS[tag]))
        elif tag in ("code", "kbd", "samp") and not self.pre:
            if not self.code:
                self.marks.append((len(self.text), "`"))
            self.code += 1
        elif tag == "pre":
            self.flush()
            self.stack.append(_Frame(tag, known))
            self.pre += 1
        elif tag == "code" and self.pre:
            self.stack[-1].attrs = known | {k: v for k, v in self.stack[-1].attrs.items() if v}
        elif tag in ("tr", "td", "th") or tag in _HEADS or tag in _BLOCKS or tag in ("ul", "ol", "li", "blockquote", "table"):
            self._begin(tag, known)

    def _begin(self, tag: str, known: dict) -> None:
        closes = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, ("p",))
        bounds = ("ul", "ol") if tag == "li" else ("table",) if tag in ("tr", "td", "th") else ("li", "td", "th", "blockquote", "div", "section", "article")
        for i in range(len(self.stack) - 1, 0, -1):  # an element whose end tag is left out ends here
            if self.stack[i].tag in closes:
                self._finish(i)
                break
            if self.stack[i].tag in bounds:
                break
        self.flush()
        self.stack.append(_Frame(tag, known))

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while True:  # what was left open inside ends too
            last = self.open.pop()
            self.out -= last in LEFT_OUT or last == "title"
            if not self.out:
                self._end(last)
            if last == tag:
                return

    def _end(self, tag: str) -> None:
        if tag == "a":
            if self.links:
                self._end_link()
        elif tag in ("code", "kbd", "samp") and not self.pre:
            self.code = max(0, self.code - 1)
            if not self.code and any(m == "`" for _, m in self.marks):
                at = next(a for a, m in reversed(self.marks) if m == "`")
                self.marks = [(a, m) for a, m in self.marks if a < at]
                inner = _SPACE.sub(" ", "".join(self.text[at:])).strip()
                del self.text[at:]
                fence = "`" * (max((len(x) for x in re.findall("`+", inner)), default=0) + 1)
                pad = " " * (inner.startswith("`") or inner.endswith("`"))
                self.text.append(f"{fence}{pad}{inner}{pad}{fence}" if inner else "")
        elif tag in _MARKS and not self.pre and not self.code:
            if any(m == _MARKS[tag] for _, m in self.marks):
                self._end_mark()
        else:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    self._finish(i)
                    return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    # blocks

    def _finish(self, upto: int) -> None:
        """Render the frames above `upto`, and it, into their parents."""
        while len(self.stack) > upto:
            frame = self.stack[-1]
            if frame.tag == "pre":
                self.pre -= 1
                body = "".join(self.text).strip("\n")
                self.text = []
                language = re.search(r"(?:language|lang)-([\w+#-]+)", frame.attrs.get("class") or "")
                fence = "`" * max(3, max((len(x) for x in re.findall("`+", body)), default=0) + 1)
                lines = [fence + (language[1] if language else ""), *body.split("\n"), fence] if body.strip() else []
            else:
                self.flush()
                lines = self._rendered(frame)
            self.stack.pop()
            if lines:
                self.stack[-1].blocks.append(lines)

    def _rendered(self, frame: _Frame) -> list[str]:
        tag, inner = frame.tag, frame.blocks
        if tag in _HEADS:
            text = " ".join(line.strip() for block in inner for line in block)
            return [_HEADS[tag] + text] if text else []
        if tag in ("ul", "ol"):
            return [line for block in inner for line in block]
        if tag == "li":
            parent = next((f for f in reversed(self.stack[:-1]) if f.tag in ("ul", "ol")), None)
            if parent is None:
                lead = "- "
            elif parent.tag == "ul":
                lead = "- "
            else:
                start = parent.attrs.get("start") or "1"
                lead = f"{(int(start) if start.isdigit() else 1) + parent.number}. "
                parent.number += 1
            body: list[str] = []
            for i, block in enumerate(inner):
                tight = i == 0 or re.match(r"[-\d]", block[0]) and re.match(r"(?:- |\d+\. )", block[0])
                body += block if tight else ["", *block]
            return [(lead if i == 0 else " " * len(lead) * bool(line)) + line for i, line in enumerate(body)]
        if tag == "blockquote":
            return ["> " + line if line else ">" for line in _joined(inner)]
        if tag in ("td", "th"):
            cell = " ".join(line.strip() for block in inner for line in block).replace("|", "\\|")
            frame.attrs["cell"] = cell
            row = next((f for f in reversed(self.stack[:-1]) if f.tag == "tr"), None)
            if row is not None:
                row.attrs.setdefault("cells", []).append(cell)
                return []
            return [cell] if cell else []
        if tag == "tr":
            cells = frame.attrs.get("cells", [])
            table = next((f for f in reversed(self.stack[:-1]) if f.tag == "table"), None)
            if table is not None:
                if any(cells):
                    table.attrs.setdefault("rows", []).append(cells)
                return []
            return [" ".join(cells)] if any(cells) else []
        if tag == "table":
            rows = frame.attrs.get("rows", [])
            wide = max(map(len, rows), default=0)
            told = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
            rule = ["| " + " | ".join(["---"] * wide) + " |"]
            around = _joined(inner)
            return [*around, *([""] if around and told else []), *told[:1], *(rule if told else []), *told[1:]]
        return _joined(inner)

    def result(self) -> str:
        self._finish(1)
        self.flush()
        return "\n".join(_joined(self.stack[0].blocks))


def _joined(blocks: list[list[str]]) -> list[str]:
    """The lines of blocks with an empty line between."""
    out: list[str] = []
    for block in blocks:
        out += [*([""] if out else []), *block]
    return out


def markdown(page: str | None, origin: str = "", most: int | None = None) -> str:
    """A page as Markdown: headings, paragraphs, lists, quotes, code, tables, links and images made absolute by `origin`.

    What navigates or acts (menus, forms, scripts, headers, footers) is left out. Cut at a
    space beyond `most` characters, and marked. A null page is empty; markup that the parser
    cannot read ends the page there.
    """
    writer = _Writer(origin or "")
    try:
        writer.feed(page or "")
        writer.close()
    except AssertionError:  # a marked section that the parser does not know
        pass
    text = writer.result().strip()
    if most is not None and len(text) > most:
        text = text[:most].rsplit(" ", 1)[0] + TRUNCATED
    return text


def markdown_of(pages: Column, origins: Column, most: int | None = None) -> Column:
    """Pages as Markdown, whole columns through Arrow; a null page is empty."""

    @F.pandas_udf("string")
    def written(texts: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([markdown(t, u or "", most) for t, u in zip(texts, links, strict=True)], dtype=object)

    return written(pages, origins)
