"""Sinks: JSON lines and tables that are replaced as a whole by one renamed pointer."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "current"


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out, letters stay as they are."""
    df.write.mode("overwrite").json(path)


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, root: str) -> str:
    """Write a new version beside the old one, then move the pointer; readers see the one or the other.

    A rename over an existing pointer is not atomic on every file system, so each
    pointer has a number of its own and the highest is current.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root}/{version}")
    number = _latest(spark, root)[0] + 1
    if not claim(spark, f"{root}/{POINTER}.{number:012d}", version):
        raise FileExistsError(f"version {number} was committed by another writer")
    return version


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file, whole from the first, if there is none; of several writers exactly one is told so.

    Where Spark's own rename could replace a file (a local or mounted folder), a hard link
    decides; elsewhere a rename, which fails if its target is there.
    """
    folder, _, name = path.rpartition("/")
    draft, fs = _files(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    fs.mkdirs(draft.getParent())
    if fs.getScheme() == "file":
        own = draft.toUri().getPath()
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, f"{os.path.dirname(own)}/{name}")
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    target, _ = _files(spark, path)
    if not fs.exists(target) and fs.rename(draft, target):
        return True
    fs.delete(draft, False)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, read by the driver."""
    place, fs = _files(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def numbered(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of the files `name.<number>` in a folder, ascending."""
    pattern, fs = _files(spark, f"{folder}/{name}.*")
    return sorted(int(str(s.getPath().getName()).rsplit(".", 1)[1]) for s in fs.globStatus(pattern) or [])


def _latest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    pattern, fs = _files(spark, f"{root}/{POINTER}.*")
    found = sorted(str(s.getPath().toString()) for s in fs.globStatus(pattern) or [])
    return (int(found[-1].rsplit(".", 1)[1]), found[-1]) if found else (0, None)


def current_table(spark: SparkSession, root: str) -> DataFrame | None:
    """The version that the newest pointer names, or None before the first."""
    _, pointer = _latest(spark, root)
    if pointer is None:
        return None
    version = spark.read.option("wholetext", "true").text(pointer).first()[0]
    return spark.read.parquet(f"{root}/{version}")


def append_keys(keys: DataFrame, path: str) -> None:
    """Add keys to those that are done; a run that dies adds all of a task's keys or none."""
    keys.write.mode("append").parquet(path)


def done(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The keys that are done, each once; none before the first were added."""
    hadoop, fs = _files(spark, path)
    return spark.read.schema(schema).parquet(path).distinct() if fs.exists(hadoop) else spark.createDataFrame([], schema)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file beside its place and rename it there, over an older one if there is one."""
    draft, fs = _files(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    target, _ = _files(spark, path)
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"cannot write {path}")


def publish(spark: SparkSession, root: str, outputs: DataFrame, render: Callable[[str, str], str], send: Callable[[str, str, str], None], remote: str) -> DataFrame:
    """Write the outputs (name, content) that are new or changed as Markdown and a page, send both, and record what was sent; gives the names sent.

    The outputs are documents for people, some thousands at most. What was sent before a
    failure is recorded, so that a repeated run sends only the rest; unchanged content is neither written nor sent.
    """
    schema = "remote string, name string, sha256 string"
    held = current_table(spark, f"{root}/published")
    held = spark.createDataFrame([], schema) if held is None else held
    known = {(r.remote, r.name): r.sha256 for r in held.collect()}
    sent: list[tuple[str, str, str]] = []
    try:
        for row in outputs.orderBy("name").toLocalIterator():
            digest = hashlib.sha256(row.content.encode()).hexdigest()
            if known.get((remote, row.name)) == digest:
                continue
            write_text(spark, f"{root}/{row.name}.md", row.content)
            write_text(spark, f"{root}/{row.name}.html", render(row.name, row.content))
            send(remote, row.name, row.content)
            sent.append((remote, row.name, digest))
    finally:
        if sent:
            fresh = spark.createDataFrame(sent, schema)
            replace_table(held.join(fresh.select("remote", "name"), ["remote", "name"], "left_anti").unionByName(fresh), f"{root}/published")
    return spark.createDataFrame([(n,) for _, n, _ in sent], "name string")


def save_result(spark: SparkSession, root: str, name: str, result: dict) -> list[str]:
    """Write a result (question, passages, answer, complete) as JSON, its answer and its context as Markdown; gives the paths.

    One that is not complete gets names that end in `.partial`, which `publish` never sees; a complete one leaves them be.
    """
    if not isinstance(result.get("question"), str) or not isinstance(result.get("passages"), list):
        raise ValueError("a result has a question and passages")
    mark = "" if result.get("complete", True) else ".partial"
    blocks = [f"[{i}] {p['metadata'].get('pdf_path', '')}\n{p['content']}" for i, p in enumerate(result["passages"], 1)]
    files = {f"{name}{mark}.json": json.dumps(result, ensure_ascii=False, indent=1), f"{name}-context{mark}.md": "\n\n".join(blocks)}
    if result.get("answer"):
        files[f"{name}{mark}.md"] = result["answer"]
    for file, text in files.items():
        write_text(spark, f"{root}/{file}", text)
    return [f"{root}/{file}" for file in files]


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, by name; nothing if there is no such folder."""
    pattern, fs = _files(spark, f"{folder}/*")
    return sorted(str(s.getPath().getName()) for s in fs.globStatus(pattern) or [])


def existing(spark: SparkSession, paths: list[str]) -> list[bool]:
    """Whether there is something at each of some paths."""
    out = []
    for path in paths:
        place, fs = _files(spark, path)
        out.append(bool(fs.exists(place)))
    return out
