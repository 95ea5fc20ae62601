"""The page that lists all digests: catalogue rows, what is missing, and the page with its data as JSON."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import calendar as cal
from loomspan.functions.text import strip


def title(text: Column, label: Column) -> Column:
    """The first heading without its marks; the label where there is none or it is empty."""
    line = F.get(F.filter(F.transform(F.split(text, "\r\n|[\n\r]"), strip), lambda x: x.startswith("#")), 0)
    return F.coalesce(F.nullif(strip(F.regexp_replace(line, "^#+", "")), F.lit("")), label)


def _span(kind: Column, label: Column) -> tuple[Column, Column]:
    day = F.when(label.rlike(r"^\d{4}-\d{2}-\d{2}$"), label.try_cast("date"))
    monday = cal.monday_of_label(label)
    month = F.when(label.rlike(r"^\d{4}-\d{2}$"), F.concat(label, F.lit("-01")).try_cast("date"))
    first = F.when(kind == "daily", day).when(kind == "weekly", monday).when(kind == "monthly", month)
    last = F.when(kind == "daily", day).when(kind == "weekly", F.date_add(monday, 6)).when(kind == "monthly", F.last_day(month))
    return first, last


def items(digests: DataFrame) -> DataFrame:
    """(kind, label, href, size, start, end, title [, mtime]) of digests (kind, label, text [, mtime]); rows whose label is no such period are left out."""
    first, last = _span(F.col("kind"), F.col("label"))
    text = F.coalesce("text", F.lit(""))
    href = F.concat("kind", F.lit("-"), "label", F.lit(".html"))
    found = digests.select("kind", "label", href.alias("href"), F.octet_length(text).cast("long").alias("size"), first.alias("start"), last.alias("end"), title(text, F.col("label")).alias("title"), *(["mtime"] if "mtime" in digests.columns else []))
    return found.where("start IS NOT NULL")


def missing(found: DataFrame, days: DataFrame) -> DataFrame:
    """(kind, label) of the periods from the first to the last day that have no digest."""
    return cal.expected_periods(days).join(found.select("kind", "label").distinct(), ["kind", "label"], "left_anti")


def script_json(value: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.replace(F.to_json(value), F.lit("</"), F.lit("<\\/"))


def payload(found: DataFrame, gone: DataFrame) -> DataFrame:
    """One row with the page's data as JSON. Its size is that of the calendar: three rows a day at most, however large the corpus."""
    names = ["kind", "label", "href", "size", "start", "end", "title", *(["mtime"] if "mtime" in found.columns else [])]  # sorted by kind, then label
    kept = found.agg(F.array_sort(F.collect_list(F.struct(*names))).alias("items"))
    lost = gone.agg(F.array_sort(F.collect_list(F.struct("kind", "label"))).alias("missing"))
    return kept.crossJoin(lost).select(script_json(F.struct("items", "missing")).alias("payload"))  # one row each


def page(data: str, name: str = "Digests") -> str:
    """A page that shows the payload as a table, filtered by what is typed."""
    return f"""<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>{html.escape(name)}</title></head>
<body><h1>{html.escape(name)}</h1><input id="find" placeholder="Filter"><table id="list"></table><h2>Missing</h2><p id="gone"></p>
<script type="application/json" id="data">{data}</script>
<script>
const data = JSON.parse(document.getElementById("data").textContent);
function show(wanted) {{
  const rows = data.items.filter(x => (x.kind + " " + x.label + " " + x.title).toLowerCase().includes(wanted)).map(x => {{
    const row = document.createElement("tr"), link = document.createElement("a");
    link.href = x.href; link.textContent = x.title;
    for (const part of [x.kind, x.label, link, String(x.size)]) {{ const cell = document.createElement("td"); cell.append(part); row.append(cell); }}
    return row;
  }});
  document.getElementById("list").replaceChildren(...rows);
}}
document.getElementById("find").addEventListener("input", e => show(e.target.value.toLowerCase()));
document.getElementById("gone").textContent = data.missing.map(x => x.label).join(", ");
show("");
</script></body></html>
"""
