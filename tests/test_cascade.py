"""Digests that follow their parts, and followers that end with their query."""

import hashlib
import sys
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomspan.operators import cascade
from loomspan.streaming import progress

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Writer:
    """A model that notes what it is asked for; its text follows from the whole prompt, or from its head alone."""

    def __init__(self, path, whole=True, fail=""):
        self.path, self.whole, self.fail = str(path), whole, fail

    def __call__(self, prompt):
        head = prompt.split("\n")[0]
        with open(self.path, "a") as f:
            f.write(head + "\n")
        if self.fail and self.fail in head:
            raise ValueError("no")
        return f"{head}: " + hashlib.sha256((prompt if self.whole else head).encode()).hexdigest()

    def asked(self):
        return sorted(Path(self.path).read_text().split("\n"))[1:] if Path(self.path).exists() else []


def leaves(spark, changed=(), days=60, skip=()):
    first = date(2024, 1, 25)
    rows = [(first + timedelta(i), f"text of {i}" + " changed" * (i in changed)) for i in range(days) if i not in skip]
    df = spark.createDataFrame(rows, "day date, text string")
    return df.select(F.col("day").cast("string").alias("label"), "text"), cascade.calendar_parts(df)


def states(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.kind, r.state), []).append(r.label)
    return {k: sorted(v) for k, v in out.items()}


def test_a_change_goes_up_as_far_as_texts_change(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    first = states(cascade.run(*leaves(spark), root, Writer(tmp_path / "1")))
    assert set(first) == {("weekly", "generated"), ("monthly", "generated")}
    assert first["monthly", "generated"] == ["2024-01", "2024-02", "2024-03"] and len(first["weekly", "generated"]) == 9
    again = Writer(tmp_path / "2")
    assert set(states(cascade.run(*leaves(spark), root, again))) == {("weekly", "reused"), ("monthly", "reused")} and again.asked() == []
    one = Writer(tmp_path / "3")
    got = states(cascade.run(*leaves(spark, changed={6}), root, one))  # 31 January: a week of two months
    assert got["weekly", "generated"] == ["2024-W05"] and got["monthly", "generated"] == ["2024-01", "2024-02"] and len(one.asked()) == 3
    assert states(cascade.run(*leaves(spark, changed={6}), root, Writer(tmp_path / "4"))).keys() == {("weekly", "reused"), ("monthly", "reused")}
    same = Writer(tmp_path / "5", whole=False)
    cascade.run(*leaves(spark, changed={6, 20}), root, same)
    cut = Writer(tmp_path / "6", whole=False)
    got = states(cascade.run(*leaves(spark, changed={6, 21}), root, cut))  # the week is written again and comes out as before
    assert got["weekly", "generated"] == ["2024-W07"] and ("monthly", "generated") not in got
    assert {r.label for r in cascade.current(spark, root).where("kind = 'weekly'").collect()} == set(first["weekly", "generated"])


def test_failures_are_tried_again_and_what_has_no_parts_goes(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    got = states(cascade.run(*leaves(spark, days=20), root, Writer(tmp_path / "1", fail="W05")))
    assert got["weekly", "failed"] == ["2024-W05"] and ("monthly", "generated") in got
    fixed = Writer(tmp_path / "2")
    got = states(cascade.run(*leaves(spark, days=20), root, fixed))
    assert got["weekly", "generated"] == ["2024-W05"] and got["monthly", "generated"] == ["2024-01", "2024-02"]
    fewer = states(cascade.run(*leaves(spark, days=20, skip=set(range(4, 11))), root, Writer(tmp_path / "3")))
    assert fewer["weekly", "dropped"] == ["2024-W05"] and "2024-02" in fewer["monthly", "generated"]
    forced = states(cascade.run(*leaves(spark, days=5), root, Writer(tmp_path / "4"), force=True))
    assert ("weekly", "reused") not in forced
    none = leaves(spark, days=0)
    assert set(states(cascade.run(*none, root, Writer(tmp_path / "5")))) <= {("weekly", "dropped"), ("monthly", "dropped")}
    assert cascade.current(spark, root).count() == 0 and cascade.run(*none, root, Writer(tmp_path / "6")).count() == 0


def events(spark, folder):
    spark.range(10).withColumn("v", F.col("id") % 3).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_follower_ends_with_its_query(spark, tmp_path):
    events(spark, str(tmp_path / "in"))
    stream = events(spark, str(tmp_path / "in"))
    out = f"file://{tmp_path}/out"

    def start():
        return stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    assert progress.lines(spark, out).count() == 0
    query, follower = progress.followed(spark, start, out)
    query.awaitTermination(120)
    assert follower.ended.wait(60)
    told = progress.lines(spark, out).orderBy("number").collect()
    assert [r.number for r in told] == list(range(1, len(told) + 1)) and told[-1].event == "ended"
    assert sum(r.rows or 0 for r in told if r.event == "batch") == 20


def test_a_follower_ends_with_a_query_that_fails(spark, tmp_path):
    stream = events(spark, str(tmp_path / "in"))
    out = f"file://{tmp_path}/out"

    def broken(batch, epoch):
        raise RuntimeError("the sink is gone")

    query, follower = progress.followed(spark, lambda: stream.writeStream.foreachBatch(broken).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(), out)
    with pytest.raises(Exception, match="the sink is gone"):
        query.awaitTermination(120)
    assert follower.ended.wait(60)
    last = progress.lines(spark, out).orderBy(F.desc("number")).first()
    assert last.event == "failed" and last.error
    other, second = progress.followed(spark, lambda: events(spark, str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(), out)
    other.awaitTermination(120)
    assert second.ended.wait(60) and progress.lines(spark, out).select("number").distinct().count() == progress.lines(spark, out).count()
    with pytest.raises(ValueError):
        progress.followed(spark, lambda: (_ for _ in ()).throw(ValueError("never began")), out)
