"""Every registered query of the library beside its SQL, on the smallest tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value.item() if hasattr(value, "item") else value


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 2e-7 * max(1.0, abs(a))
    return str(a) == str(b)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    got = catalogue.queries()[name](spark, SF)
    want = sql.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    left = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    right = [tuple(plain(r[i]) for i in order) for r in want.fetchall()]
    key = lambda r: tuple((v is None, "" if isinstance(v, float) else str(v)) for v in r) + tuple((v is None, v or 0.0) for v in r if isinstance(v, float) or v is None)
    left, right = sorted(left, key=key), sorted(right, key=key)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert all(near(x, y) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", ["intraday_rv", "loss_derivatives"])
def test_values_without_a_logarithm_match_sql(spark, tmp_path, name):
    """Values of 0, below 0, null and of a forecast of 0 (-9): infinities and NaN are told apart, which ``plain`` does not."""
    values = [(5.0, 0.0, 7.0), (0.0, 0.0, 3.0), (2.0, -1.0, 2.5), (4.0, None, 6.0), (0.0, None, None), (-9.0, 8.0, 9.0), (2.0, 2.5, 2.0)]
    rows = [(10 * day + i, dt.datetime(2024, 1, 1 + day, i), "view", v) for day, each in enumerate(values) for i, v in enumerate(each)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").selectExpr("*", "event_id AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want, got = con.sql(catalogue.oracle_sql()[name]), catalogue.queries()[name](spark, str(tmp_path))
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    right = text(want.fetchall())
    assert text(got.select(*want.columns).collect()) == right and any("inf" in r for r in right) and any("nan" in r for r in right)


def test_lags_share_one_window(spark):
    """All lags, leads and targets of a dataset plan as one exchange, one sort and one window over the panel."""
    from tidemark.plans import dataset as ds
    from tidemark.sources.simulated import simulate

    frame = simulate(spark, [1], n=50)
    path = frame.select("entity_id", "ts_utc", "open", "high", "low", "close")
    built = ds.build(path, ds.DatasetSpec(features=(ds.Feature("lag_log_return", {"lags": 3}), ds.Feature("lag_squared_log_return", {"lags": 2})), target=ds.Feature("forward_realized_variance", {"horizon": 5})))
    plan = built.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity_id") == 1


def test_filters_reach_the_scan(spark):
    from tidemark.operators.panel import time_range

    rows = time_range(spark.read.parquet(f"{SF}/orders.parquet"), "1995-01-01", "1995-12-31", time="o_orderdate").select("o_orderdate", "o_totalprice")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_custkey" not in plan
