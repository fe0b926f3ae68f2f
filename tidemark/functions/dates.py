"""Dates: calendars, strict parsing, briefing windows and sanity of what feeds claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def calendar(spark: SparkSession, first: str, last: str, step: str, name: str = "day") -> DataFrame:
    """Days from the first to the last in steps such as `1 week`."""
    day = lambda x: F.lit(x).cast("date")
    return spark.range(1).select(F.explode(F.sequence(day(first), day(last), F.expr(f"INTERVAL {step}"))).alias(name))


def calendar_of(rows: DataFrame, at: str, name: str, step: str) -> DataFrame:
    """Days in steps such as `7 days`, from the start of the first row's `name` (week, month) to the last row: one pass for the bounds, whose one row is expanded."""
    bounds = rows.agg(F.min(F.date_trunc(name, at)).cast("date").alias("first"), F.max(at).cast("date").alias("last"))
    return bounds.select(F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {step}"))).alias(name))


def strict_date(text: Column) -> Column:
    """A day of the form 2024-01-31 that exists, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def window_start(last: Column, now: Column, days: int = 7) -> Column:
    """Where the next window begins: at the last one's end, but so many days back at most; the first goes back that far."""
    floor = now - F.make_interval(days=F.lit(days))
    return F.greatest(F.coalesce(last, floor), floor)


def sane_time(claimed: Column, now: Column) -> Column:
    """A claimed time, or null where it lies before 1990, after the next year or more than an hour ahead."""
    year = F.year(claimed)
    return F.when((year >= 1990) & (year <= F.year(now) + 1) & (claimed <= now + F.expr("INTERVAL 1 HOUR")), claimed)
