"""Data sources for what comes from outside: day logs, listings and checkouts.

    spark.dataSource.register(remote.DayLogs)
    spark.read.format("daylogs").options(reader="package.module:function", first="2024-01-01", last="2024-03-31").load()
    spark.readStream.format("daylogs").options(...).load()

A source names its reader by an import path, which tasks import for themselves. Days,
prefixes and shards of a checkout are dealt to tasks by their names; only tasks ask the
other side, so the driver lists nothing. A stream's offset is the last day, or the
revision, that a batch ends with: a batch that is planned again after a failure asks for
the same days.
"""

from __future__ import annotations

import importlib
import json
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomspan.functions import text as tx

TRIES, PARTS = 3, 8


def imported(name: str) -> Callable:
    """The function that `module:name` names."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"{name!r} names no function; write module:function")
    return getattr(importlib.import_module(module), attribute)


def tried(ask: Callable, tries: int = TRIES):
    """What a call gives, asked for again where it fails with an OSError; (result, None) or (None, error)."""
    problem = None
    for _ in range(tries):
        try:
            return ask(), None
        except OSError as error:
            problem = f"{type(error).__name__}: {error}"
    return None, problem


def _dealt(items: list, parts: int) -> list[list]:
    """Runs of neighbours, as even as they can be, none of them empty."""
    parts = max(1, min(parts, len(items)))
    return [items[i * len(items) // parts : (i + 1) * len(items) // parts] for i in range(parts)] if items else []


@dataclass
class Days(InputPartition):
    days: list

    def __init__(self, days: list):
        super().__init__(days)
        self.days = days


class _DayReader:
    """What batch and stream share: (day, raw, error) of some days.

    In a batch a day that cannot be fetched is a row with an error; in a stream it fails
    its batch, which is planned again with the same days, so no day is lost.
    """

    def __init__(self, options: dict):
        self.reader, self.where = options["reader"], options.get("path", "")
        self.first = date.fromisoformat(options["first"])
        self.last = date.fromisoformat(options["last"]) if "last" in options else None
        self.parts, self.tries = int(options.get("partitions", PARTS)), int(options.get("tries", TRIES))

    def until(self) -> date:
        today = datetime.now(timezone.utc).date()
        return today if self.last is None else self.last

    def between(self, after: date, last: date) -> list[Days]:
        days = [after + timedelta(i) for i in range(1, (last - after).days + 1)]
        return [Days([d.isoformat() for d in part]) for part in _dealt(days, self.parts)]

    def rows(self, partition: Days, strict: bool) -> Iterator[tuple]:
        ask = imported(self.reader)
        for day in partition.days:
            raw, problem = tried(lambda day=day: ask(self.where, date.fromisoformat(day)), self.tries)
            if problem and strict:
                raise OSError(f"{day}: {problem}")
            yield date.fromisoformat(day), raw, problem


class _DayBatch(_DayReader, DataSourceReader):
    def partitions(self) -> list[Days]:
        return self.between(self.first - timedelta(1), self.until()) or [Days([])]

    def read(self, partition: Days) -> Iterator[tuple]:
        return self.rows(partition, strict=False)


class _DayStream(_DayReader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"day": (self.first - timedelta(1)).isoformat()}

    def latestOffset(self) -> dict:
        return {"day": max(self.until(), self.first - timedelta(1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Days]:
        return self.between(date.fromisoformat(start["day"]), date.fromisoformat(end["day"]))

    def read(self, partition: Days) -> Iterator[tuple]:
        return self.rows(partition, strict=True)

    def commit(self, end: dict) -> None:
        return None


class DayLogs(DataSource):
    """Logs by day. Options: reader (module:function of (path, date) -> text), path, first, last (else today), partitions, tries."""

    @classmethod
    def name(cls) -> str:
        return "daylogs"

    def schema(self) -> str:
        return "day date, raw string, error string"

    def reader(self, schema) -> _DayBatch:
        return _DayBatch(dict(self.options))

    def streamReader(self, schema) -> _DayStream:
        return _DayStream(dict(self.options))


@dataclass
class Prefix(InputPartition):
    prefix: str

    def __init__(self, prefix: str):
        super().__init__(prefix)
        self.prefix = prefix


class _ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Prefix]:
        return [Prefix(p) for p in json.loads(self.options.get("prefixes", '[""]'))] or [Prefix("")]

    def read(self, partition: Prefix) -> Iterator[tuple]:
        yield from imported(self.options["reader"])(self.options.get("path", ""), partition.prefix)


class Listing(DataSource):
    """(path, size, mtime) of a remote folder. Options: reader (module:function of (path, prefix) -> rows), path, prefixes (a JSON list, a task for each)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "path string, size long, mtime long"

    def reader(self, schema) -> _ListingReader:
        return _ListingReader(dict(self.options))


@dataclass
class Shard(InputPartition):
    revision: str
    since: str
    shard: int

    def __init__(self, revision: str, since: str, shard: int):
        super().__init__(shard)
        self.revision, self.since, self.shard = revision, since, shard


class _CheckoutReader:
    """Files of a repository by shards of a hash of their path.

    The repository is an object with head() -> revision, changed(since, revision) -> paths
    (all of them since ""; a path that is gone too) and content(revision, path) -> bytes or
    None; `reader` makes one of `path`.
    """

    def __init__(self, options: dict):
        self.reader, self.where = options["reader"], options.get("path", "")
        self.shards, self.revision = int(options.get("partitions", PARTS)), options.get("revision")

    def repository(self):
        return imported(self.reader)(self.where)

    def dealt(self, since: str, revision: str) -> list[Shard]:
        return [Shard(revision, since, i) for i in range(self.shards)] if revision and revision != since else []

    def read(self, partition: Shard) -> Iterator[tuple]:
        if not partition.revision:
            return
        repository = self.repository()
        for path in repository.changed(partition.since, partition.revision):
            if zlib.crc32(path.encode()) % self.shards == partition.shard:
                content = repository.content(partition.revision, path)
                yield path, partition.revision, None if content is None else bytearray(content)


class _CheckoutBatch(_CheckoutReader, DataSourceReader):
    def partitions(self) -> list[Shard]:
        return self.dealt("", self.revision or self.repository().head()) or [Shard("", "", 0)]


class _CheckoutStream(_CheckoutReader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"revision": ""}

    def latestOffset(self) -> dict:
        return {"revision": self.revision or self.repository().head()}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return self.dealt(start["revision"], end["revision"])

    def commit(self, end: dict) -> None:
        return None


class Checkout(DataSource):
    """(path, revision, content) of a repository; a stream brings what changes, a null content for what is gone. Options: reader (module:function of path), path, revision, partitions."""

    @classmethod
    def name(cls) -> str:
        return "checkout"

    def schema(self) -> str:
        return "path string, revision string, content binary"

    def reader(self, schema) -> _CheckoutBatch:
        return _CheckoutBatch(dict(self.options))

    def streamReader(self, schema) -> _CheckoutStream:
        return _CheckoutStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the formats daylogs, listing and checkout known to a session."""
    for source in (DayLogs, Listing, Checkout):
        spark.dataSource.register(source)


def inventory(spark: SparkSession, reader: str, path: str, prefixes: list[str]) -> DataFrame:
    """(path, size, mtime) of a remote folder, listed by tasks; keys are percent-encoded, hidden files are left out."""
    register(spark)
    rows = spark.read.format("listing").options(reader=reader, path=path, prefixes=json.dumps(prefixes)).load()
    return rows.where(~F.col("path").rlike(r"(^|/)\.")).select(tx.path_key(F.col("path")).alias("path"), "size", "mtime")


# Stand-ins that read a folder which all tasks see.


def folder_day(path: str, day: date) -> str:
    """The log of a day from a folder of `YYYY-MM-DD.log` files; bytes that are no UTF-8 are read as Windows-1252 or Latin-1."""
    with open(f"{path}/{day.isoformat()}.log", "rb") as f:
        raw = f.read()
    for encoding in ("utf-8", "cp1252"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def folder_listing(path: str, prefix: str) -> Iterator[tuple[str, int, int]]:
    """What a folder holds below a prefix."""
    for top, _, files in os.walk(os.path.join(path, prefix)):
        for name in files:
            full = os.path.join(top, name)
            facts = os.stat(full)
            yield os.path.relpath(full, path), facts.st_size, int(facts.st_mtime)


class FolderRepository:
    """Revisions as folders `0001`, `0002`, ...; the last is the head."""

    def __init__(self, path: str):
        self.path = path

    def head(self) -> str:
        return max((d for d in os.listdir(self.path) if os.path.isdir(f"{self.path}/{d}")), default="")

    def _files(self, revision: str) -> dict[str, bytes]:
        return {p: self.content(revision, p) for p, _, _ in folder_listing(f"{self.path}/{revision}", "")} if revision else {}

    def changed(self, since: str, revision: str) -> list[str]:
        old, new = self._files(since), self._files(revision)
        return sorted(p for p in old.keys() | new.keys() if old.get(p) != new.get(p))

    def content(self, revision: str, path: str) -> bytes | None:
        try:
            with open(f"{self.path}/{revision}/{path}", "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None
