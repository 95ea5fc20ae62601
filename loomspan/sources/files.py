"""File sources: chat logs, digests, chunks in JSON lines, notes, binary inventories."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import calendar as cal
from loomspan.functions.text import percent_decoded, usable

CHUNK_SCHEMA = "index int, start int, end int, text string, enriched_text string"
#: Bytes that the Windows encoding leaves undefined; a text that holds one is read as Latin-1.
UNDEFINED = "[\u0081\u008d\u008f\u0090\u009d]"
_DEFINED = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_WINDOWS = (bytes(_DEFINED).decode("latin-1"), bytes(_DEFINED).decode("cp1252"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else Windows-1252, else Latin-1; null stays null."""
    latin = F.decode(content, "ISO-8859-1")
    windows = F.when(latin.rlike(UNDEFINED), latin).otherwise(F.translate(latin, *_WINDOWS))
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(windows)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def below(path: Column, root: str) -> Column:
    """A path's part below the root, however the file system writes the two."""
    plain = F.regexp_replace(percent_decoded(path), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*", "")
    prefix = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", root).strip("/") + "/"
    return F.regexp_replace(plain, F.lit("^\\Q" + prefix + "\\E"), F.lit(""))


def inventory(spark: SparkSession, root: str, pattern: str = "*", with_content: bool = False) -> DataFrame:
    """(path, size, mtime [, content]) of files under a folder; files and folders below it whose names begin with a dot are left out.

    Spark itself passes over names that begin with an underscore; a pattern that begins with one finds them.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    files = read.where(~below(F.col("path"), root).rlike(r"(^|/)\.[^/]*(/|$)"))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if with_content else []))


@dataclass(frozen=True)
class Corpus:
    """How a folder of text files becomes documents: what to take, how to key it, what is known of all of it."""

    name: str
    pattern: str = "*.txt"
    fallback: str | None = None  # taken where no file fits the pattern
    key: str = "name"  # name, path (below the root) or typed (last folder and name)
    metadata: tuple[tuple[str, str], ...] = ()
    kinds: tuple[str, ...] = ()  # the folders that are read, one kind of source each; empty for the root


#: The shapes of corpora that are known, each by its own root.
CORPORA = {
    c.name: c
    for c in (
        Corpus("logs", "*.log"), Corpus("logs-or-any", "*.log", fallback="*"), Corpus("threads", "*.txt"), Corpus("mails", "*.txt", metadata=(("source_type", "mail"),)),
        Corpus("pages", "*.md", key="path"), Corpus("wiki", "*.mdwn", key="path", metadata=(("source_type", "wiki"),)), Corpus("site", "*.md", key="typed", kinds=("posts", "pages")),
    )
}


def corpus(spark: SparkSession, root: str, spec: Corpus) -> DataFrame:
    """(key, corpus, source_type, text, size) of a corpus; empty files are left out, and folders that are not there have none."""
    folders = [f"{root.rstrip('/')}/{k}" for k in spec.kinds] or [root]
    out = None
    for folder, kind in zip(folders, spec.kinds or (dict(spec.metadata).get("source_type"),), strict=True):
        files = inventory(spark, folder, spec.pattern, with_content=True)
        if spec.fallback is not None and files.isEmpty():
            files = inventory(spark, folder, spec.fallback, with_content=True)
        name = file_name(percent_decoded(F.col("path")))
        key = {"name": name, "path": below(F.col("path"), folder), "typed": F.concat(F.lit(f"{kind}/"), name)}[spec.key]
        got = files.where("size > 0").select(key.alias("key"), F.lit(spec.name).alias("corpus"), F.lit(kind).cast("string").alias("source_type"), decoded(F.col("content")).alias("text"), "size")
        out = got if out is None else out.unionByName(got)
    return out


def day_logs(spark: SparkSession, root: str) -> DataFrame:
    """(day, path, raw, mtime) of `*.log` files whose names are dates; any other file is left out."""
    files = inventory(spark, root, "*.log", with_content=True)
    day = F.when(stem(F.col("path")).rlike(r"^\d{4}-\d{2}-\d{2}$"), stem(F.col("path")).try_cast("date"))
    return files.select(day.alias("day"), "path", decoded(F.col("content")).alias("raw"), "mtime").where("day IS NOT NULL")


def digests(spark: SparkSession, root: str, only_usable: bool = False) -> DataFrame:
    """(kind, label, start, end, text, size, mtime) of `daily|weekly|monthly/<label>.md`; labels that name no period are left out."""
    files = inventory(spark, root, "*.md", with_content=True).withColumn("kind", F.element_at(F.split("path", "/"), -2)).withColumn("label", stem(F.col("path")))
    label = F.col("label")
    day = F.when(label.rlike(r"^\d{4}-\d{2}-\d{2}$"), label.try_cast("date"))
    month = F.when(label.rlike(r"^\d{4}-\d{2}$"), F.concat(label, F.lit("-01")).try_cast("date"))
    start = F.when(F.col("kind") == "daily", day).when(F.col("kind") == "weekly", cal.monday_of_label(label)).when(F.col("kind") == "monthly", month)
    end = F.when(F.col("kind") == "daily", F.col("start")).when(F.col("kind") == "weekly", F.date_add("start", 6)).otherwise(F.last_day("start"))
    found = files.withColumn("start", start).where("start IS NOT NULL")
    found = found.select("kind", "label", "start", end.alias("end"), decoded(F.col("content")).alias("text"), "size", "mtime")
    return found.where(usable(F.col("text"))) if only_usable else found


def chunk_lines(spark: SparkSession, root: str) -> DataFrame:
    """(chunk_id, file, index, start, end, text) of chunk files; an enriched text takes the text's place."""
    rows = spark.read.schema(CHUNK_SCHEMA).option("pathGlobFilter", "*.jsonl").json(root).withColumn("file", stem(F.col("_metadata.file_name")))
    return rows.select(F.concat_ws("-", "file", F.col("index").cast("string")).alias("chunk_id"), "file", "index", "start", "end", F.coalesce("enriched_text", "text").alias("text"))


def notes(spark: SparkSession, root: str) -> DataFrame:
    """(key, text, size) of non-empty .mdwn, .md and .txt files in any case, keyed by their path below the root."""
    files = inventory(spark, root, with_content=True).where(F.lower("path").rlike(r"\.(mdwn|md|txt)$") & (F.col("size") > 0))
    return files.select(below(F.col("path"), root).alias("key"), decoded(F.col("content")).alias("text"), "size")
