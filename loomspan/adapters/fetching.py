"""What comes from outside, behind protocols: logs by day, files to add, links and what their answers tell."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import date
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import markup
from loomspan.functions import text as tx
from loomspan.operators import manifests

MOST = 6000


class DayLog(Protocol):
    def __call__(self, day: date) -> str: ...


class Fetcher(Protocol):
    """(status, content type, body) of a link; raises OSError where there is no answer."""

    def __call__(self, url: str, most_bytes: int) -> tuple[int, str, bytes]: ...


def day_logs(spark: SparkSession, days: DataFrame, held: DataFrame, fetch: DayLog) -> DataFrame:
    """(day, raw, error): logs that are held, and the others as the fetcher brings them; a day that cannot be fetched has an error and no text.

    held: day, raw. Days are fetched in tasks, not on the driver.
    """
    hits, misses = manifests.read_through(days, held, "day")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for day in batch.column(0).to_pylist():
                try:
                    rows.append((day, fetch(day), None))
                except OSError as error:
                    rows.append((day, None, f"{type(error).__name__}: {error}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.date32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["day", "raw", "error"])

    return hits.select("day", "raw", F.lit(None).cast("string").alias("error")).unionByName(misses.mapInArrow(run, "day date, raw string, error string"))


def charset_of(content_type: str, body: bytes) -> str:
    """The stated charset, else UTF-8 where the bytes are that, else Windows-1252; an unknown name counts as not stated."""
    for part in content_type.lower().split(";")[1:]:
        name, _, value = part.strip().partition("=")
        if name == "charset":
            try:
                return "".encode(value.strip("\"' ")) and value or value.strip("\"' ")
            except LookupError:
                break
    try:
        body.decode()
    except UnicodeDecodeError as error:
        if error.end < len(body) - 3:  # not merely cut within a letter
            return "cp1252"
    return "utf-8"


def fetch_pages(links: DataFrame, fetch: Fetcher, keys: list[str], most: int = MOST, skip_hosts: tuple[str, ...] = ()) -> DataFrame:
    """(keys, url, status, content_type, body, failure) of links that are worth reading; the others are not asked for. Errors are data."""
    kinds = {c: links.schema[c].dataType.simpleString() for c in keys}
    url = F.col("url")
    skipped = F.lit(False)
    for host in skip_hosts:
        skipped = skipped | tx.on_host(url, host)
    wanted = links.where(~(skipped | tx.is_binary(url))).select(*keys, "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, link in enumerate(batch.column("url").to_pylist()):
                try:
                    got = (*fetch(link, 20 * most), None)
                except OSError as error:
                    got = (None, None, None, f"{type(error).__name__}: {error}")
                given = [batch.column(k).slice(i, 1) for k in keys]
                types = [pa.int32(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([*given, pa.array([link]), *(pa.array([v], t) for v, t in zip(got, types, strict=True))], [*keys, "url", "status", "content_type", "body", "failure"])

    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    return wanted.mapInArrow(run, f"{schema}, url string, status int, content_type string, body binary, failure string")


def describe(fetched: DataFrame, keys: list[str], most: int = MOST, skip_hosts: tuple[str, ...] = ()) -> DataFrame:
    """(keys, url, kind, title, text, error, scholarly) of answers (keys, url, status, content_type, body [, failure]).

    The kind is skipped, binary, pdf or html; an error leaves title and kind. At most 20
    times `most` bytes of a body are read, and `most` characters of its text are kept.
    """

    @F.pandas_udf("string")
    def decode(content_type, body):
        return content_type.combine(body, lambda c, b: None if b is None else bytes(b[: 20 * most]).decode(charset_of(c or "", bytes(b[: 20 * most])), "replace"))

    @F.pandas_udf("string")
    def body_text(pages):
        return pages.map(lambda p: markup.read(p, most), na_action="ignore")

    url = F.col("url")
    failure = F.col("failure") if "failure" in fetched.columns else F.lit(None).cast("string")
    skipped = F.lit(False)
    for host in skip_hosts:
        skipped = skipped | tx.on_host(url, host)
    kind = F.when(skipped, "skipped").when(tx.is_binary(url), "binary").when(tx.is_pdf(url, F.col("content_type")), "pdf").otherwise("html")
    error = (
        F.when(F.col("kind") == "skipped", "skipped host").when(F.col("kind") == "binary", "binary or media, not read").when(F.col("failure").isNotNull(), F.col("failure"))
        .when((F.col("kind") != "pdf") & (F.col("status") >= 400), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    )
    rows = fetched.select(*keys, "url", "status", "content_type", "body", failure.alias("failure"), kind.alias("kind")).withColumn("error", error)
    rows = rows.withColumn("page", F.when(F.col("error").isNull() & (F.col("kind") == "html"), decode("content_type", "body")))
    title = F.coalesce(F.nullif(tx.html_title(F.col("page")), F.lit("")), tx.title_from_url(url))
    rows = rows.select(*keys, "url", "kind", "error", title.alias("title"), body_text("page").alias("text"), tx.html_description(F.col("page")).alias("description"), tx.is_scholarly(url).alias("scholarly"))
    return rows.select(*keys, "url", "kind", "title", F.when(F.col("text").isNotNull(), tx.described(F.col("text"), F.col("description"))).alias("text"), "error", "scholarly")


def add_file(spark: SparkSession, root: str, path: str, content: bytes) -> str:
    """Add a PDF below a folder under a safe relative path: written beside its place, then renamed, which fails if the place is taken; gives its digest."""
    ok = spark.createDataFrame([(path, bytearray(content))], "path string, content binary").select(tx.is_safe_path(F.col("path")).alias("p"), tx.is_pdf_content(F.col("content")).alias("c")).first()
    if not ok.p:
        raise ValueError(f"{path!r} is not a relative path to a PDF")
    if not ok.c:
        raise ValueError("the content does not begin like a PDF")
    digest = hashlib.sha256(content).hexdigest()
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{root.rstrip('/')}/{path}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    draft = hadoop.Path(target.getParent(), f".{digest}")
    stream = fs.create(draft, True)
    stream.write(bytearray(content))
    stream.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise FileExistsError(path)
    return digest


def remote_inventory(spark: SparkSession, listing: Callable[[], Iterator[tuple[str, int, int]]]) -> DataFrame:
    """(path, size, mtime) of a remote folder, as a listing gives it; keys are percent-encoded, hidden files are left out."""
    rows = spark.createDataFrame(list(listing()), "path string, size long, mtime long")
    return rows.where(~F.col("path").rlike(r"(^|/)\.")).select(tx.path_key(F.col("path")).alias("path"), "size", "mtime")
