"""Answers in Markdown with their numbered citations made into links.

An answer is scanned once, line by line. Whatever Markdown already gives a meaning of its
own is copied: code, links, images, bracketed addresses, escapes. A bracket of numbers
becomes one link for each source, unless a number has no source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"\s*(\d+)\s*(?:[-–]\s*(\d+)\s*)?")
_BULLET = re.compile(r" {0,3}(?:[-+*]|\d+[.)])\s")


def cited(inside: str, sources: int) -> list[int] | None:
    """The numbers of `1, 3-5`; None if it is no such list, [] if a number has no source."""
    found: list[int] = []
    missing = False
    for part in inside.replace(";", ",").split(","):
        numbers = _PART.fullmatch(part)
        if numbers is None:
            return None
        first, last = int(numbers[1]), int(numbers[2] or numbers[1])
        if 1 <= first <= last <= sources:
            found += range(first, last + 1)
        else:
            missing = True
    return [] if missing else found


def _bracket_end(line: str, at: int) -> int:
    """The place after the bracket's end, or -1."""
    i = at + 1
    while i < len(line):
        if line[i] == "]":
            return i + 1
        i += 2 if line[i] == "\\" else 1
    return -1


def _copied(line: str, at: int) -> int:
    """Where a construct that begins at `at` and is not ours to change ends; `at` itself if there is none."""
    c = line[at]
    if c == "\\":
        return min(at + 2, len(line))
    if c == "`":
        run = len(line[at:]) - len(line[at:].lstrip("`"))
        close = line.find("`" * run, at + run)
        return at + run if close < 0 else close + run
    if c == "<":
        close = line.find(">", at + 2)
        return at if close < 0 else close + 1
    if c == "[":
        end = _bracket_end(line, at)
        if end > 0 and line.startswith("(", end) and (close := line.find(")", end)) > 0:
            return close + 1
        if end > 0 and line.startswith("[", end) and cited(line[at + 1 : end - 1], 0) is None and (close := line.find("]", end)) > 0:
            return close + 1
    return at


def link_line(line: str, urls: list[str]) -> str:
    out, i = [], 0
    while i < len(line):
        if (end := _copied(line, i)) > i:
            out.append(line[i:end])
            i = end
            continue
        if line[i] == "[" and (end := _bracket_end(line, i)) > 0 and (numbers := cited(line[i + 1 : end - 1], len(urls))):
            out.append(" ".join(rf"[\[{n}\]](<{urls[n - 1]}>)" for n in numbers))
            i = end
            continue
        out.append(line[i])
        i += 1
    return "".join(out)


def link_answer(answer: str | None, urls: list[str] | None) -> str:
    """The whole answer; a null is empty. Lines of bold text become headings, lists begin after a blank line."""
    urls, out, fence = urls or [], [], ""
    for line in (answer or "").splitlines():
        bare = line.strip()
        indent = len(line) - len(line.lstrip(" "))
        if fence:
            out.append(line)
            if indent < 4 and len(bare) >= len(fence) and set(bare) == {fence[0]}:
                fence = ""
            continue
        if indent < 4 and bare[:3] in ("```", "~~~"):
            fence = bare[: len(bare) - len(bare.lstrip(bare[0]))]
            out.append(line)
            continue
        definition = indent < 4 and bare.startswith("[") and "]:" in bare and bare.index("]") == bare.index("]:") > 1
        if indent >= 4 or line.startswith("\t") or definition:
            out.append(line)
            continue
        open_above = bool(out) and out[-1].strip() != ""
        if line.startswith("**") and len(bare) > 4 and bare.endswith("**") and "*" not in bare[2:-2]:
            out += [""] * open_above + ["## " + link_line(bare[2:-2], urls), ""]
            continue
        if open_above and _BULLET.match(line) and not _BULLET.match(out[-1]):
            out.append("")
        out.append(link_line(line, urls))
    return "\n".join(out)


def link_answers(results: DataFrame) -> DataFrame:
    """(key, markdown) of results (key long, answer string, urls array<string>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [link_answer(a, u) for a, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "markdown"])

    return results.select(F.col("key").cast("long").alias("key"), "answer", "urls").mapInArrow(run, "key long, markdown string")
