"""Meetings and working days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starting_within(meetings: DataFrame, start: str, end: str) -> DataFrame:
    """Meetings whose start lies in [start, end)."""
    return meetings.where((F.col("start") >= F.lit(start).cast("timestamp_ntz")) & (F.col("start") < F.lit(end).cast("timestamp_ntz")))


def by_date(meetings: DataFrame) -> DataFrame:
    minutes = F.timestamp_diff("MINUTE", F.col("start"), F.col("end"))
    return meetings.groupBy(F.coalesce(F.date_format("start", "yyyy-MM-dd"), F.lit("unknown")).alias("day")).agg(F.count("*").alias("n"), F.sum(minutes).alias("minutes"))


def horizon(day: Column, n: int) -> Column:
    """The n-th working day after `day`."""
    return F.element_at(F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, 2 * n + 4)), lambda d: F.weekday(d) < 5), n)


def next_working_day(day: Column) -> Column:
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))
