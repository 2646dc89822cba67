"""The exchange calendar against fixed lists of sessions, holidays and early closes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import panel
from tidemark.sources import eod

#: Sessions of the New York Stock Exchange in each year from 1990. Fixed values.
SESSIONS = [
    253, 253, 254, 253, 252, 252, 254, 253, 252, 252, 252, 248, 252, 252, 252, 252, 251, 251, 253, 252, 252, 252, 250, 252, 252, 252, 252, 251, 251, 252, 253, 252, 251, 250, 252,
]
#: Its weekdays without a session from 2018 to 2024. Fixed values.
CLOSED = """
2018-01-01 2018-01-15 2018-02-19 2018-03-30 2018-05-28 2018-07-04 2018-09-03 2018-11-22 2018-12-05 2018-12-25
2019-01-01 2019-01-21 2019-02-18 2019-04-19 2019-05-27 2019-07-04 2019-09-02 2019-11-28 2019-12-25
2020-01-01 2020-01-20 2020-02-17 2020-04-10 2020-05-25 2020-07-03 2020-09-07 2020-11-26 2020-12-25
2021-01-01 2021-01-18 2021-02-15 2021-04-02 2021-05-31 2021-07-05 2021-09-06 2021-11-25 2021-12-24
2022-01-17 2022-02-21 2022-04-15 2022-05-30 2022-06-20 2022-07-04 2022-09-05 2022-11-24 2022-12-26
2023-01-02 2023-01-16 2023-02-20 2023-04-07 2023-05-29 2023-06-19 2023-07-04 2023-09-04 2023-11-23 2023-12-25
2024-01-01 2024-01-15 2024-02-19 2024-03-29 2024-05-27 2024-06-19 2024-07-04 2024-09-02 2024-11-28 2024-12-25
""".split()
#: Days of 2018 to 2024 that closed at one o'clock. Fixed values.
EARLY = """
2018-07-03 2018-11-23 2018-12-24 2019-07-03 2019-11-29 2019-12-24 2020-11-27 2020-12-24 2021-11-26 2022-11-25 2023-07-03 2023-11-24 2024-07-03 2024-11-29 2024-12-24
""".split()
#: Easter Sundays. Fixed values.
EASTER = {1961: "04-02", 1981: "04-19", 1990: "04-15", 2000: "04-23", 2008: "03-23", 2011: "04-24", 2019: "04-21", 2024: "03-31", 2038: "04-25", 2076: "04-19"}


@pytest.fixture(scope="module")
def table(spark):
    return calendar.sessions(spark, "1990-01-01", "2024-12-31").cache()


def test_sessions_of_each_year(table):
    got = {r.y: r.n for r in table.groupBy(F.year("session").alias("y")).agg(F.count("*").alias("n")).collect()}
    assert got == {1990 + k: n for k, n in enumerate(SESSIONS)}


def test_closed_days_and_early_closes(spark, table):
    days = {r.session for r in table.filter("session >= '2018-01-01'").collect()}
    every = [dt.date(2018, 1, 1) + dt.timedelta(days=k) for k in range(2557)]
    assert [str(d) for d in every if d.weekday() < 5 and d not in days] == CLOSED
    assert [str(r.session) for r in table.filter("session >= '2018-01-01' and early").orderBy("session").collect()] == EARLY
    shut = {r.session for r in table.filter("session between '2001-09-10' and '2001-09-17'").collect()}
    assert shut == {dt.date(2001, 9, 10), dt.date(2001, 9, 17)}


def test_easter(spark):
    years = spark.createDataFrame([(y,) for y in EASTER], "y int")
    assert {r.y: r.d for r in years.select("y", F.date_format(calendar.easter(F.col("y")), "MM-dd").alias("d")).collect()} == EASTER


def test_hours_follow_summer_time(table):
    got = {str(r.session): (r.open_utc.strftime("%H:%M"), r.close_utc.strftime("%H:%M")) for r in table.filter("session in ('2024-01-03', '2024-07-02', '2024-07-03', '2024-11-29')").collect()}
    assert got == {"2024-01-03": ("14:30", "21:00"), "2024-07-02": ("13:30", "20:00"), "2024-07-03": ("13:30", "17:00"), "2024-11-29": ("14:30", "18:00")}


def test_times_move_to_the_next_close(spark, table):
    times = ["2024-07-03 16:00:00", "2024-07-03 17:00:00", "2024-07-03 17:00:01", "2024-07-04 12:00:00", "2024-07-06 00:00:00", "2024-12-31 21:00:01", "1989-12-29 12:00:00", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k int, t string").select("k", F.to_timestamp("t").alias("ts_utc"))
    got = {r.k: r.ts_utc and r.ts_utc.strftime("%Y-%m-%d %H:%M") for r in panel.sessionise(rows, sessions=table).collect()}
    assert got == {0: "2024-07-03 17:00", 1: "2024-07-03 17:00", 2: "2024-07-05 20:00", 3: "2024-07-05 20:00", 4: "2024-07-08 20:00", 5: None, 6: None, 7: None}
    plan = panel.sessionise(rows, sessions=table)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_fetch_ranges_count_sessions(spark):
    assert str(calendar.shifted(spark, "2024-07-05", 2)) == "2024-07-02"  # the fourth is no session
    assert str(calendar.shifted(spark, "2024-07-04", 0)) == "2024-07-05"
    assert str(calendar.shifted(spark, "2001-09-17", 1)) == "2001-09-10"
    assert str(calendar.shifted(spark, "2024-01-02", 250)) == "2023-01-03"


def test_a_holiday_is_not_asked_for(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    calls = []

    def fetch(entities, start, end):
        calls.append((start, end))
        days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS d").filter("weekday(d) < 5 and d not in (date'2024-07-04')")
        return days.select(F.lit("SPY").alias("ticker"), F.col("d").cast("string").alias("date"), *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")))

    from tidemark.schema import Query

    source = eod.CachedSource(fetch, str(tmp_path / "cache"), "update", exchange="XNYS")
    source.fetch(spark, Query("market.ohlcv", ("close",), "2024-07-01", "2024-07-03", ("SPY",)))
    source.fetch(spark, Query("market.ohlcv", ("close",), "2024-07-01", "2024-07-04", ("SPY",)))
    assert calls == [("2024-07-01", "2024-07-03")]
    got = source.fetch(spark, Query("market.ohlcv", ("close",), "2024-07-01", "2024-07-07", ("SPY",))).data
    assert calls[1:] == [("2024-07-05", "2024-07-05")] and got.count() == 4


def test_series_know_what_they_lack(spark, table):
    rows = spark.createDataFrame([("A", "2024-07-01"), ("A", "2024-07-02"), ("A", "2024-07-08"), ("B", "2024-07-03")], "entity_id string, d string").select("entity_id", F.to_timestamp("d").alias("ts_utc"))
    assert [(r.entity_id, str(r.session)) for r in calendar.missing_sessions(rows, table).orderBy("session").collect()] == [("A", "2024-07-03"), ("A", "2024-07-05")]
    assert calendar.missing_sessions(rows, table, ["B"]).count() == 0


class Broken:
    name = "broken"

    def read(self, entities):
        raise OSError("no route to host")

    def write(self, rows):
        raise AssertionError("a store that failed is not written to")


def test_stores_in_a_chain(spark, tmp_path):
    """Each entity comes from the first store that has all of it; earlier stores are filled; one that fails is named and left out."""
    from tidemark.schema import Query

    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    calls = []

    def fetch(entities, start, end):
        calls.append((tuple(entities), start, end))
        days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS d").filter("weekday(d) < 5 and d <> date'2024-07-04'")
        return days.crossJoin(spark.createDataFrame([(e,) for e in entities], "ticker string")).select("ticker", F.col("d").cast("string").alias("date"), *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")))

    near, far = (eod.ParquetPrices(spark, str(tmp_path / n), n) for n in ("near", "far"))
    week = lambda *e, end="2024-07-03": Query("market.ohlcv", ("close",), "2024-07-01", end, e)
    assert eod.ChainedSource([far], fetch, "XNYS").fetch(spark, week("A")).meta == {"errors": {}, "from": {"vendor": 1}}
    chain = eod.ChainedSource([Broken(), near, far], fetch, "XNYS")
    got = chain.fetch(spark, week("A", "B"))
    assert got.meta["from"] == {"far": 1, "vendor": 1} and got.meta["errors"] == {"broken": "OSError: no route to host"}
    assert got.data.count() == 6 and calls[1:] == [(("B",), "2024-07-01", "2024-07-03")]
    assert {r.entity_id for r in near.read(["A", "B", "C"]).collect()} == {"A", "B"} == {r.entity_id for r in far.read(["A", "B", "C"]).collect()}
    again = chain.fetch(spark, week("A", "B", end="2024-07-04"))  # the fourth is no session
    assert again.meta["from"] == {"near": 2} and again.data.count() == 6 and len(calls) == 2
    more = chain.fetch(spark, week("A", end="2024-07-05"))
    assert more.meta["from"] == {"vendor": 1} and more.data.count() == 4 and near.read(["A"]).count() == 4
