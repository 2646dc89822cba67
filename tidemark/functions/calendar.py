"""Exchange calendars: rules of holidays and early closes, turned into a table of sessions by Spark, a row a year to begin with."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MONDAY, TUESDAY, WEDNESDAY, THURSDAY, FRIDAY, SATURDAY, SUNDAY = range(7)


@dataclass(frozen=True)
class Rule:
    """A day of each year from ``since`` to ``until``; null in other years. ``only`` keeps it to some weekdays."""

    since: int = 1
    until: int = 9999
    only: tuple[int, ...] = tuple(range(7))

    def nominal(self, year: Column) -> Column:
        raise NotImplementedError

    def day(self, year: Column) -> Column:
        found = self.nominal(year)
        return F.when(year.between(self.since, self.until) & F.weekday(found).isin(*self.only), found)


@dataclass(frozen=True)
class On(Rule):
    """A date, moved by so many days where it falls on a Saturday or Sunday; not moved where that is None, so that the weekend has it."""

    month: int = 1
    of_month: int = 1
    saturday: int | None = -1
    sunday: int | None = 1

    def nominal(self, year: Column) -> Column:
        own = F.make_date(year, F.lit(self.month), F.lit(self.of_month))
        return F.date_add(own, F.when(F.weekday(own) == SATURDAY, self.saturday or 0).when(F.weekday(own) == SUNDAY, self.sunday or 0).otherwise(0))


@dataclass(frozen=True)
class Nth(Rule):
    """The ``n``-th weekday of its kind of a month, or with -1 the last, and so many days behind it."""

    month: int = 1
    weekday: int = MONDAY
    n: int = 1
    behind: int = 0

    def nominal(self, year: Column) -> Column:
        first = F.make_date(year, F.lit(self.month), F.lit(1))
        edge = F.last_day(first) if self.n < 0 else first
        gap = -F.pmod(F.weekday(edge) - self.weekday, F.lit(7)) if self.n < 0 else F.pmod(self.weekday - F.weekday(edge), F.lit(7)) + 7 * (self.n - 1)
        return F.date_add(edge, (gap + self.behind).cast("int"))


@dataclass(frozen=True)
class FromEaster(Rule):
    """So many days from Easter Sunday."""

    behind: int = 0

    def nominal(self, year: Column) -> Column:
        return F.date_add(easter(year), self.behind)


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by the golden number, the century's corrections and the weekday of the full moon."""
    whole = lambda x: F.floor(x).cast("int")
    golden, century = year % 19, whole(year / 100)
    moon = (century - whole(century / 4) - whole((8 * century + 13) / 25) + 19 * golden + 15) % 30
    full = moon - whole(moon / 28) * (1 - whole(F.lit(29) / (moon + 1)) * whole((21 - golden) / 11))
    weekday = (year + whole(year / 4) + full + 2 - century + whole(century / 4)) % 7
    away = full - weekday  # days from 28 March
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), away.cast("int"))


@dataclass(frozen=True)
class Exchange:
    """Zone, hours of open, close and early close (in minutes of the day), holidays, single closures, and days that close early."""

    zone: str
    opens: int = 570
    closes: int = 960
    early: int = 780
    holidays: tuple[Rule, ...] = ()
    closures: tuple[str, ...] = ()
    early_rules: tuple[Rule, ...] = ()
    early_days: tuple[str, ...] = ()


#: Rules and single days of the New York Stock Exchange. Fixed values.
NEW_YORK = Exchange(
    zone="America/New_York",
    holidays=(
        On(month=1, of_month=1, saturday=None),
        Nth(since=1998, month=1, weekday=MONDAY, n=3),
        Nth(month=2, weekday=MONDAY, n=3),
        FromEaster(behind=-2),
        Nth(month=5, weekday=MONDAY, n=-1),
        On(since=2022, month=6, of_month=19),
        On(month=7, of_month=4),
        Nth(month=9, weekday=MONDAY, n=1),
        Nth(month=11, weekday=THURSDAY, n=4),
        On(month=12, of_month=25),
    ),
    closures=(
        "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
    ),
    early_rules=(
        Nth(since=1993, month=11, weekday=THURSDAY, n=4, behind=1),
        On(since=1993, month=12, of_month=24, saturday=None, sunday=None, only=(MONDAY, TUESDAY, WEDNESDAY, THURSDAY)),
        On(since=1995, until=2012, month=7, of_month=3, saturday=None, sunday=None, only=(MONDAY, TUESDAY, THURSDAY)),
        On(since=1995, until=2012, month=7, of_month=5, saturday=None, sunday=None, only=(FRIDAY,)),
        On(since=2013, month=7, of_month=3, saturday=None, sunday=None, only=(MONDAY, TUESDAY, WEDNESDAY, THURSDAY)),
    ),
    early_days=("1997-12-26", "1999-12-31", "2003-12-26"),
)
EXCHANGES = {"XNYS": NEW_YORK, "XNAS": NEW_YORK}


def sessions(spark: SparkSession, start: Any, end: Any, exchange: Exchange | str = "XNYS") -> DataFrame:
    """(session, open_utc, close_utc, early) of the trading days of the inclusive range.

    Rules are expressions over a row a year: its holidays are one array, and its days the rest of the weekdays. Nothing
    is joined and no Python runs; a range of centuries is a few hundred rows to begin with.
    """
    x = EXCHANGES[exchange] if isinstance(exchange, str) else exchange
    low, high = (F.lit(str(t)[:10]).cast("date") for t in (start, end))
    first, last = (int(str(t)[:4]) for t in (start, end))
    dates = lambda days: [F.lit(d).cast("date") for d in days]
    year = F.col("id").cast("int")
    # a holiday of the next year may be observed at the end of this one
    shut = F.array(*(r.day(y) for r in x.holidays for y in (year, year + 1)), *dates(x.closures), F.lit(None).cast("date"))
    soon = F.array(*(r.day(year) for r in x.early_rules), *dates(x.early_days), F.lit(None).cast("date"))
    years = spark.range(first, last + 1).select(year.alias("id"), F.array_compact(shut).alias("shut"), F.array_compact(soon).alias("soon"))
    every = F.sequence(F.make_date("id", F.lit(1), F.lit(1)), F.make_date("id", F.lit(12), F.lit(31)))
    open_days = F.filter(every, lambda d: (F.weekday(d) < SATURDAY) & ~F.array_contains("shut", d) & (d >= low) & (d <= high))
    days = years.select("soon", F.explode(open_days).alias("session"))
    early = F.array_contains("soon", F.col("session"))
    at = lambda minutes: F.to_utc_timestamp(F.timestamp_add("MINUTE", minutes, F.col("session").cast("timestamp_ntz").cast("timestamp")), x.zone)
    return days.select("session", at(F.lit(x.opens)).alias("open_utc"), at(F.when(early, x.early).otherwise(x.closes)).alias("close_utc"), early.alias("early"))


def at_close(df: DataFrame, calendar: DataFrame, time: str = "ts_utc") -> DataFrame:
    """``df`` with its times (UTC) moved to the first close of ``calendar(session, close_utc)`` at or after them; null before its first day and behind its last close.

    Of each date the calendar says the next close from its beginning on and the one after that: some thousand rows, broadcast. Rows are not shuffled.
    """
    order = W.orderBy("close_utc")  # over the calendar alone
    marks = calendar.select("close_utc", F.lag(F.to_date("close_utc")).over(order).alias("_before"), F.lead("close_utc").over(order).alias("_then"))
    closing = F.to_date("close_utc")
    spans = marks.select(F.explode(F.sequence(F.coalesce(F.date_add("_before", 1), closing), closing)).alias("_day"), "close_utc", "_then")
    instant = F.col(time).cast("timestamp")
    met = df.withColumn("_day", F.to_date(instant)).join(F.broadcast(spans), "_day", "left")
    close = F.when(instant <= F.col("close_utc"), F.col("close_utc")).otherwise(F.col("_then"))
    return met.withColumn(time, close.cast(df.schema[time].dataType)).select(*df.columns)


def shifted(spark: SparkSession, day: Any, sessions_back: int, exchange: Exchange | str = "XNYS") -> date | None:
    """The session so many before the first one at or after ``day``: from where to fetch so that so many rows lie before it."""
    day = date.fromisoformat(str(day)[:10])
    years = sessions_back // 200 + 1
    table = sessions(spark, day.replace(year=day.year - years, day=1), day.replace(year=day.year + 1, day=1), exchange)
    ahead = table.filter(F.col("session") >= F.lit(day)).agg(F.min("session")).first()[0]
    if sessions_back <= 0 or ahead is None:
        return ahead
    before = table.filter(F.col("session") < F.lit(ahead)).orderBy(F.col("session").desc()).limit(sessions_back).agg(F.min("session"), F.count("*")).first()
    return before[0] if before[1] == sessions_back else None


def without_sessions(gaps: DataFrame, calendar: DataFrame, since: str = "gap_from", until: str = "gap_to") -> DataFrame:
    """``gaps`` cut to the sessions in them, and without those that hold none: a holiday is not asked for.

    The sessions are a table of a few thousand rows, broadcast; each gap takes its first and last.
    """
    kind = gaps.schema[since].dataType
    found = gaps.withColumn("_gap", F.monotonically_increasing_id())
    inside = (F.col("session") >= F.to_date(since)) & (F.col("session") <= F.to_date(until))
    names = [c for c in gaps.columns if c not in (since, until)]
    held = found.join(F.broadcast(calendar.select("session")), inside).groupBy("_gap", *names).agg(F.min("session").alias(since), F.max("session").alias(until))
    return held.withColumns({c: F.col(c).cast(kind) for c in (since, until)}).select(*gaps.columns)


def missing_sessions(rows: DataFrame, calendar: DataFrame, entities: Sequence[str] | None = None, by: str = "entity_id", time: str = "ts_utc") -> DataFrame:
    """(by, session) of the calendar's sessions between a series' first and last day that it lacks; of all series, or of ``entities``."""
    rows = rows if entities is None else rows.filter(F.col(by).isin(list(entities)))
    have = rows.select(by, F.to_date(time).alias("session")).distinct()
    spans = have.groupBy(by).agg(F.min("session").alias("_a"), F.max("session").alias("_z"))
    due = spans.join(F.broadcast(calendar.select("session")), F.col("session").between(F.col("_a"), F.col("_z"))).select(by, "session")
    return due.join(have, [by, "session"], "left_anti")
