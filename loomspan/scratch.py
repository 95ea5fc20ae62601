"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing a Parquet table, never by a local checkpoint: a lost
executor then costs only the tasks that it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    Only a local session may go without that setting; it gets a temporary folder.
    On a cluster a missing setting is an error, since no machine-local folder is shared.
    """
    if named := spark.conf.get(KEY, None):
        return named.rstrip("/")
    if made := spark.sparkContext.getCheckpointDir():
        return made.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {KEY} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='loomspan-')}"
    return _own[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/loomspan/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "zstd", free: bool = False) -> DataFrame:
    """Write `df` once as Parquet and read it back; empty results keep their schema. With `free` the write's shuffle files go when it ends, not when the driver collects its garbage."""
    path, conf = fresh_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(FREE, None)
    if free:
        conf.set(FREE, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if free:
            conf.unset(FREE) if before is None else conf.set(FREE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
