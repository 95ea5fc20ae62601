"""SparkSession factory with the settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "loomspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `master` only where no cluster sets one."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.legacy.javaCharsets": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
