"""Days, ISO weeks and months as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monday_of(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def week_label(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def monday_of_label(label: Column) -> Column:
    """The Monday of a label like 2021-W05; null where there is no such week."""
    year = F.regexp_extract(label, r"^(\d{4})-W(\d{2})$", 1).try_cast("int")
    week = F.regexp_extract(label, r"^(\d{4})-W(\d{2})$", 2).try_cast("int")
    day = F.date_add(monday_of(F.make_date(year, F.lit(1), F.lit(4))), 7 * (week - 1))
    return F.when(week_label(day) == label, day)


def days_between(first: Column, last: Column) -> Column:
    """All days of a range, none where it is empty."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))


def expected_periods(days: DataFrame) -> DataFrame:
    """(kind, label): the days that there are, and every week and month from first to last."""
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    daily = days.select(F.lit("daily").alias("kind"), F.col("day").cast("string").alias("label")).distinct()
    weekly = span.select(F.explode(F.sequence(monday_of(F.col("a")), monday_of(F.col("b")), F.expr("interval 7 days"))).alias("d"))
    monthly = span.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("d"))
    return daily.unionByName(weekly.select(F.lit("weekly").alias("kind"), week_label(F.col("d")).alias("label"))).unionByName(monthly.select(F.lit("monthly").alias("kind"), month_label(F.col("d")).alias("label")))


def missing_days(days: DataFrame) -> DataFrame:
    """Days between the first and the last that are not there."""
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    return span.select(F.explode(days_between(F.col("a"), F.col("b"))).alias("day")).join(days.select("day").distinct(), "day", "left_anti")


def month_weeks(days: DataFrame) -> DataFrame:
    """(month, week_start): an ISO week belongs to every month that it touches."""
    weeks = days.select(monday_of(F.col("day")).alias("week_start")).distinct()
    return weeks.select("week_start", F.explode(F.array_distinct(F.array(month_label(F.col("week_start")), month_label(F.date_add("week_start", 6))))).alias("month"))


def days_to_fetch(days: DataFrame, today: Column, floor: Column) -> DataFrame:
    """Days from the later of the first held day and the floor up to today that are not held; with none held, today alone."""
    held = days.select("day").where("day IS NOT NULL")
    first = held.agg(F.min("day").alias("a")).select(F.when(F.col("a").isNull(), today).otherwise(F.greatest("a", floor)).alias("a"))
    span = first.select(F.explode(days_between(F.col("a"), today)).alias("day"))
    return span.join(held.distinct(), "day", "left_anti").select("day")
