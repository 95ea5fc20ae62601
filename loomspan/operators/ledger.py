"""A ledger of money: reservations before a call, settled, refunded or left open after it.

The log is append-only. A commit is a numbered file that one writer alone can make; it
holds its events and what is spent after them, so whether a reservation fits is decided
against the last commit, and writers that run at once cannot overspend: one that finds
its number taken decides again. `fold` sums the whole log by reservation, as a table, and
must agree with the last commit.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.adapters.models import MOST_BYTES, OVERHEAD, checked_vectors
from loomspan.operators.chunking import chunked
from loomspan.sources import keyed, sinks

EVENTS = "id string, kind string, amount double, tokens long, request string, error string, at double"
ENTRY, TRIES = "entry", 200


class BudgetExceeded(RuntimeError):
    """A reservation that does not fit the limit; nothing was reserved."""


class Refused(RuntimeError):
    """A call that the other side refused and does not charge."""


@dataclass
class Reservation:
    id: str
    amount: float


class Ledger:
    """A ledger below a folder, with a limit in money."""

    def __init__(self, spark: SparkSession, root: str, limit: float):
        if not 0 < limit < float("inf"):
            raise ValueError("a limit is positive and finite")
        self.spark, self.root, self.limit = spark, root, limit

    def last(self) -> tuple[int, float]:
        """(number, spent) of the last commit."""
        numbers = sinks.numbered(self.spark, f"{self.root}/log", ENTRY)
        if not numbers:
            return 0, 0.0
        text = sinks.read_text(self.spark, f"{self.root}/log/{ENTRY}.{numbers[-1]:012d}")
        return numbers[-1], json.loads(text.splitlines()[-1])["spent"]

    def _commit(self, decide: Callable[[float], dict]) -> None:
        """Append the event that `decide` makes of what is spent, at the first number that is free; it may refuse by an error."""
        for turn in range(TRIES):
            number, spent = self.last()
            event = decide(spent)
            after = spent + event.pop("change")
            line = json.dumps(event | {"at": time.time(), "spent": after})
            if sinks.claim(self.spark, f"{self.root}/log/{ENTRY}.{number + 1:012d}", line + "\n"):
                return
            time.sleep(random.uniform(0, 0.005 * min(turn + 1, 20)))
        raise RuntimeError(f"{TRIES} other writers were first")

    def reserve(self, amount: float) -> Reservation:
        """Reserve an amount, all or nothing."""
        if not 0 <= amount < float("inf"):
            raise ValueError("an amount is finite and not negative")
        made = Reservation(uuid.uuid4().hex, amount)

        def decide(spent: float) -> dict:
            if spent + amount > self.limit:
                raise BudgetExceeded(f"{spent:.6f} are spent or reserved; {amount:.6f} more exceed {self.limit:.6f}")
            return {"id": made.id, "kind": "reserve", "amount": amount, "change": amount}

        self._commit(decide)
        return made

    def settle(self, made: Reservation, cost: float, tokens: int | None = None, request: str | None = None) -> None:
        """Replace the reservation by the cost; a cost that is no finite amount leaves it as it is and is an error."""
        if not 0 <= cost < float("inf"):
            raise ValueError("a cost is finite and not negative")
        self._commit(lambda _: {"id": made.id, "kind": "settle", "amount": cost, "tokens": tokens, "request": request, "change": cost - made.amount})

    def refund(self, made: Reservation, error: str = "") -> None:
        """Give the reservation back: the call is known to cost nothing."""
        self._commit(lambda _: {"id": made.id, "kind": "refund", "amount": 0.0, "error": error[:1000], "change": -made.amount})

    def fail(self, made: Reservation, error: str) -> None:
        """Note a call whose outcome is not known; its reservation stays."""
        self._commit(lambda _: {"id": made.id, "kind": "fail", "amount": made.amount, "error": error[:1000], "change": 0.0})

    def events(self) -> DataFrame:
        if not sinks.numbered(self.spark, f"{self.root}/log", ENTRY):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).json(f"{self.root}/log")


def fold(events: DataFrame) -> DataFrame:
    """(id, reserved, cost, tokens, state) of every reservation of a log (id, kind, amount, tokens).

    A settlement or refund decides, the later by order of kinds refund before settle where a
    log has both; else the reservation stands, as reserved or failed. Null amounts count as
    0, events without an id are left out, and an id without a reservation has reserved 0.
    """
    amount = lambda kind: F.max(F.when(F.col("kind") == kind, F.coalesce("amount", F.lit(0.0))))
    each = events.where("id IS NOT NULL").groupBy("id").agg(amount("reserve").alias("r"), amount("settle").alias("s"), amount("refund").alias("b"), amount("fail").alias("f"), F.max("tokens").alias("tokens"))
    cost = F.when(F.col("s").isNotNull(), F.col("s")).when(F.col("b").isNotNull(), 0.0)
    state = F.when(F.col("s").isNotNull(), "received").when(F.col("b").isNotNull(), "refunded").when(F.col("f").isNotNull(), "failed").otherwise("reserved")
    return each.select("id", F.coalesce("r", F.lit(0.0)).alias("reserved"), cost.alias("cost"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), state.alias("state"))


def usage(folded: DataFrame) -> DataFrame:
    """One row (requests, accounted, unresolved, tokens): what was paid, and what is still reserved for calls of which no end is known."""
    return folded.agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("accounted"),
        F.coalesce(F.sum(F.when(F.col("cost").isNull(), F.col("reserved"))), F.lit(0.0)).alias("unresolved"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )


#: A model that tells what it used: (vectors, tokens) of texts.
Metered = Callable[[Sequence[str]], tuple[Sequence[Sequence[float]], int]]
VECTORS = "key string, embedding array<float>"


def embed(rows: DataFrame, root: str, model: Metered, dimensions: int, ledger: Ledger, price: float, batch: int = 1000) -> DataFrame:
    """(key, embedding, state) of distinct rows (key, text) under a ledger: cached, embedded, refused, failed or too long.

    Vectors that the cache, a keyed table below `root`, holds come back without a call. For
    the others the most that they can cost is reserved in one commit before any call, or
    nothing is called; `price` is money for a token, of which a text has at most its bytes
    and `OVERHEAD`. Afterwards the reservation is settled at what the calls used, a refused
    call at nothing, and one that failed otherwise at all it had reserved. A run that dies
    leaves its reservation open. Texts of one key are equal; a null text is empty.
    """
    spark = rows.sparkSession
    text = F.coalesce("text", F.lit(""))
    wanted = rows.where("key IS NOT NULL").groupBy("key").agg(F.max(text).alias("text"))
    wanted = scratch.materialize(wanted.withColumn("most", F.octet_length("text").cast("long") + OVERHEAD), "wanted")
    cache = f"{root}/vectors"
    held = scratch.materialize(keyed.read(spark, cache, VECTORS, wanted.select("key")), "cached")
    asked = wanted.join(held.select("key"), "key", "left_anti")
    fits = asked.where(F.col("most") <= MOST_BYTES)
    most = fits.agg(F.coalesce(F.sum("most"), F.lit(0)).alias("n")).first().n
    made = scratch.materialize(_called(fits, model, dimensions, batch), "embedded") if not most else None
    if made is None:
        hold = ledger.reserve(most * price)
        try:
            made = scratch.materialize(_called(fits, model, dimensions, batch), "embedded")
            used = made.groupBy("state").agg(F.sum("tokens").alias("tokens")).collect()  # three states
            keyed.upsert(made.where("state = 'embedded'").select("key", "embedding"), cache, ["key"])
        except Exception as error:
            ledger.fail(hold, str(error))
            raise
        tokens = sum(r.tokens for r in used)
        if tokens or any(r.state == "embedded" for r in used):
            ledger.settle(hold, min(tokens * price, hold.amount) if any(r.state == "failed" for r in used) else tokens * price, tokens)
        else:
            ledger.refund(hold, "refused")
    long = asked.where(F.col("most") > MOST_BYTES).select("key", F.lit(None).cast("array<float>").alias("embedding"), F.lit("too long").alias("state"))
    return held.withColumn("state", F.lit("cached")).unionByName(made.drop("tokens")).unionByName(long)


def _called(rows: DataFrame, model: Metered, dimensions: int, batch: int) -> DataFrame:
    """(key, embedding, state, tokens): a batch's tokens stand in its first row; those of a batch that failed are the most it could use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for held in chunked(given, batch):
            try:
                vectors, tokens = model([t for _, t, _ in held])
                vectors, state = checked_vectors(vectors, len(held), dimensions), "embedded"
            except Refused:
                vectors, tokens, state = [None] * len(held), 0, "refused"
            except Exception:  # noqa: BLE001  whether it was charged is not known
                vectors, tokens, state = [None] * len(held), sum(m for _, _, m in held), "failed"
            spent = [tokens] + [0] * (len(held) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in held]), pa.array(vectors, pa.list_(pa.float32())), pa.array([state] * len(held)), pa.array(spent, pa.int64())], ["key", "embedding", "state", "tokens"])

    return rows.select("key", "text", "most").mapInArrow(run, "key string, embedding array<float>, state string, tokens long")
