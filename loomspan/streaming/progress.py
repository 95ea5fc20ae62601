"""The progress of a streaming query, told by a listener that ends with it."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from loomspan.sources import sinks

LINE = "number long, event string, batch long, rows long, per_second double, error string"
NAME = "progress"


class Follower(StreamingQueryListener):
    """Writes a numbered line for each micro-batch of one query and one for its end, and then takes itself off the session.

    Lines are made once under the next number, so a follower of a restarted query goes on
    after the lines that are there.
    """

    def __init__(self, spark: SparkSession, out: str):
        super().__init__()
        self.spark, self.out = spark, out
        self.query: str | None = None
        self.ended = threading.Event()
        self.lock = threading.Lock()
        self.held: list[tuple[str, dict]] = []  # events from before the query's run is known
        self.number = (sinks.numbered(spark, out, NAME) or [0])[-1]

    def follow(self, query: StreamingQuery) -> Follower:
        with self.lock:
            self.query = str(query.runId)
            held, self.held = self.held, []
        for run, line in held:
            self._take(run, line)
        return self

    def _take(self, run: str, line: dict) -> None:
        with self.lock:
            if self.query is None:
                self.held.append((run, line))
                return
            if run != self.query or self.ended.is_set():
                return
            while not sinks.claim(self.spark, f"{self.out}/{NAME}.{self.number + 1:012d}", json.dumps({"number": self.number + 1} | line) + "\n"):
                self.number += 1
            self.number += 1
        if line["event"] in ("ended", "failed"):
            self.ended.set()
            # not from within the bus's own call
            threading.Thread(target=self.spark.streams.removeListener, args=(self,), daemon=True).start()

    def onQueryStarted(self, event) -> None:
        return None

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._take(str(p.runId), {"event": "batch", "batch": p.batchId, "rows": p.numInputRows, "per_second": p.processedRowsPerSecond if p.processedRowsPerSecond == p.processedRowsPerSecond else None})

    def onQueryIdle(self, event) -> None:
        return None

    def onQueryTerminated(self, event) -> None:
        error = (event.exception or "").strip().splitlines()
        self._take(str(event.runId), {"event": "failed" if event.exception else "ended", "error": error[0][:1000] if error else None})


def followed(spark: SparkSession, start, out: str) -> tuple[StreamingQuery, Follower]:
    """Start a query by `start()` with a follower that writes its progress below `out`; no batch is missed, since the follower listens before."""
    follower = Follower(spark, out)
    spark.streams.addListener(follower)
    try:
        query = start()
    except BaseException:
        spark.streams.removeListener(follower)
        raise
    return query, follower.follow(query)


def lines(spark: SparkSession, out: str) -> DataFrame:
    """(number, event, batch, rows, per_second, error) of what followers wrote; none before the first line."""
    return spark.read.schema(LINE).json(out) if sinks.numbered(spark, out, NAME) else spark.createDataFrame([], LINE)
