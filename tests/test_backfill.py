"""The race of many days in one job against the same days one after the other."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.plans import race
from tidemark.sources import simulated

CONFIG = {
    "models": {
        "ES": {"kind": "es", "params": {"restarts": 1}}, "GARCH": {"kind": "garch", "refit_policy": {"type": "every_n_days", "params": {"n_days": 25}}},
        "LOAD": {"kind": "custom", "factory": "tests.test_backfill:Ratio", "refit_policy": {"type": "always_load"}},
    },
    "training": {"min_history_days": 50, "refit_policy": {"type": "every_n_days", "params": {"n_days": 12}}},
}


class Ratio:
    """The last square times the mean outcome over the mean square of the training rows; it would use later outcomes if it were given any."""

    def __init__(self, x, y, r, seed):
        self.k = y.mean() / (r * r).mean()

    def predict(self, x, y, r):
        return self.k * r * r + 0 * y + 1e-3 * y.sum()


def contents(kept):
    forecasts = {(r.model_id, r.ticker, str(r.asof_utc), str(r.target_utc)): r.yhat for r in kept.read("forecasts").collect()}
    models = {r.model_id: (r.version, str(r.trained_end), str(r.created_utc), r.params_json, round(r.metric_value, 9)) for r in kept.read("models").collect()}
    artifacts = {(r.model_id, r.entity_id): (r.n, round(r.loss, 9)) for r in kept.read("artifacts").collect()}
    actuals = {(r.ticker, str(r.target_utc)): r.y for r in kept.read("actuals").collect()}
    return forecasts, models, artifacts, actuals


@pytest.fixture(scope="module")
def bars(spark):
    whole = simulated.simulate(spark, [1, 2], n=150)
    late = simulated.simulate(spark, [3], n=150).filter("ts_utc >= '2000-02-20'")  # long enough only in the middle of the days asked for
    gone = simulated.simulate(spark, [4], n=150).filter("ts_utc < '2000-05-10'")  # ends before the last day
    holes = simulated.simulate(spark, [5], n=150).filter("dayofmonth(ts_utc) % 4 <> 0")
    return whole.unionByName(late).unionByName(gone).unionByName(holes).cache()


def test_one_job_writes_what_the_days_write(spark, tmp_path, bars):
    first, then = ("2000-04-03", "2000-04-04"), ("2000-04-21", "2000-05-02")
    by_day, at_once = store.Store(spark, str(tmp_path / "a")), store.Store(spark, str(tmp_path / "b"))
    for start, end in (first, then):  # the second call loads what the first one fitted, and fits anew as it grows old
        race.backfill_by_day(spark, bars, by_day, CONFIG, start, end)
        periods = race.backfill(spark, bars, at_once, CONFIG, start, end)
    a, b = contents(by_day), contents(at_once)
    assert a[0].keys() == b[0].keys() and [a[0][k] for k in a[0]] == pytest.approx([b[0][k] for k in a[0]], rel=1e-9)
    assert a[1] == b[1] and a[2] == b[2] and a[3] == b[3]
    assert [len(at_once.log(n).numbers()) for n in ("forecasts", "actuals", "models")] == [2, 2, 2]  # one commit a table and call
    assert {p.model for p in periods if not p.fresh} == {"GARCH", "LOAD"} and any(p.fresh for p in periods)
    assert {k[1] for k in b[2]} == {"SIM1", "SIM2", "SIM3", "SIM4", "SIM5"} and len({k[2] for k in b[0]}) == 10


def test_lanes_change_nothing(spark, tmp_path, bars):
    one, three = store.Store(spark, str(tmp_path / "a")), store.Store(spark, str(tmp_path / "b"))
    for kept, lanes in ((one, 1), (three, 3)):
        race.backfill(spark, bars, kept, CONFIG, "2000-04-03", "2000-05-19", lanes=lanes)
    assert contents(one) == contents(three) and {k[1] for k in contents(one)[2]} == {"SIM1", "SIM2", "SIM3", "SIM4", "SIM5"}


def test_backfill_without_days_or_history(spark, tmp_path, bars):
    kept = store.Store(spark, str(tmp_path))
    assert race.backfill(spark, bars, kept, CONFIG, "2000-04-08", "2000-04-09") == []  # a weekend
    assert race.backfill(spark, bars, kept, CONFIG, "2000-01-04", "2000-01-10") == []
    assert race.backfill(spark, bars.limit(0), kept, CONFIG, "2000-04-03", "2000-04-05") == []
    assert not kept._exists("forecasts")
    with pytest.raises(ValueError, match="unknown refit policy"):
        race.backfill(spark, bars, kept, CONFIG | {"models": {"ES": {"kind": "es", "refit_policy": {"type": "sometimes"}}}}, "2000-04-03", "2000-04-05")
    forced = race.backfill(spark, bars, kept, CONFIG, "2000-04-03", "2000-04-05", force=True, only=["GARCH"])
    assert [(p.model_id, p.first == p.last, p.fresh) for p in forced] == [(f"GARCH:{n:04d}", True, True) for n in (1, 2, 3)]
    assert kept.read("forecasts").filter(F.col("model_id") == "GARCH:0002").select("asof_utc").distinct().count() == 1
