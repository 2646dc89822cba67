"""Trading days and sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def next_trading_day(day: Column) -> Column:
    """The next weekday; holidays are those of a calendar table, see ``closest_session``."""
    skip = F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1)
    return F.date_add(day, skip)


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.filter(F.weekday("day") < 5)


def closest_session(days: DataFrame, calendar: DataFrame, direction: str = "next") -> DataFrame:
    """``days(day)`` with the first session of ``calendar(session)`` at or after it (before it: ``previous``).

    Sessions are merged into the days by one sort: a running minimum from behind, or maximum from before.
    """
    from pyspark.sql import Window as W

    both = days.select("day", F.lit(None).cast("date").alias("session"), F.lit(True).alias("asked")).unionByName(calendar.select(F.col("session").alias("day"), "session", F.lit(False).alias("asked")))
    month = F.trunc("day", "year")
    if direction == "next":
        w = W.partitionBy(month).orderBy("day", F.col("asked").desc()).rowsBetween(0, W.unboundedFollowing)
        local, edge = F.min("session").over(w), F.min("session")
    else:
        w = W.partitionBy(month).orderBy("day", "asked").rowsBetween(W.unboundedPreceding, 0)
        local, edge = F.max("session").over(w), F.max("session")
    found = both.withColumn("found", local).withColumn("year", month).filter("asked")
    years = calendar.groupBy(F.trunc("session", "year").alias("y")).agg(edge.alias("edge"))
    beyond = F.col("y") > F.col("year") if direction == "next" else F.col("y") < F.col("year")
    over = found.filter("found is null").select("day", "year").distinct().join(F.broadcast(years), beyond, "left").groupBy("day").agg((F.min("edge") if direction == "next" else F.max("edge")).alias("edge"))
    return found.join(over, "day", "left").select("day", F.coalesce("found", "edge").alias("session"))


def session_close_utc(day: Column, zone: str = "America/New_York", hour: int = 16) -> Column:
    """The instant at which the session of a date closes."""
    return F.to_utc_timestamp(F.to_timestamp(day) + F.expr(f"INTERVAL {hour} HOURS"), zone)


def as_date(value: str | dt.date | dt.datetime | None) -> dt.date | None:
    """A date from what a caller may give for one."""
    if value is None or (isinstance(value, dt.date) and not isinstance(value, dt.datetime)):
        return value
    return value.date() if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value).date()


def fetch_start(start: str, lags: int) -> str:
    """The business day from which to fetch so that ``lags`` rows lie before ``start``; by an exchange's sessions ``calendar.shifted``."""
    import numpy as np

    return str(np.busday_offset(np.datetime64(start[:10]), -lags, "backward"))
