"""Operators on small frames with known results."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import dates, text
from tidemark.functions import math as fm
from tidemark.models import fanout
from tidemark.operators import diagnostics, folds, metrics, panel, recursion, signature, stats, store, windows
from tidemark.plans import dataset as ds
from tidemark.plans import race
from tidemark.sources import eod, registry, simulated

T = dt.datetime


def prices(spark, closes, entity="AAA", start="2020-01-01"):
    days = pd.bdate_range(start, periods=len(closes))
    return spark.createDataFrame([(entity, d.to_pydatetime(), *[float(c)] * 4, 1000.0) for d, c in zip(days, closes, strict=True)], "entity_id string, ts_utc timestamp, open double, high double, low double, close double, volume double")


def test_lags_and_target_align(spark):
    rows = prices(spark, [100, 102, 104, 106, 108, 110])
    built = ds.build(rows, ds.DatasetSpec(features=(ds.Feature("lag_log_return", {"lags": 2}),), target=ds.Feature("next_day_squared_return")))
    got = built.rows.orderBy("ts_utc").collect()
    c = [100, 102, 104, 106, 108, 110]
    r = [None] + [math.log(b / a) for a, b in zip(c, c[1:], strict=False)]
    assert len(got) == 2
    for i, row in enumerate(got, start=3):
        assert [row[f"ohlcv_ret_log_k{k}"] for k in range(3)] == pytest.approx([r[i - k] for k in range(3)])
        assert row["y"] == pytest.approx(r[i + 1] ** 2) and row["ret"] == pytest.approx(r[i])
    assert built.catalog.count() == 3


def test_spec_errors(spark):
    rows = prices(spark, [1, 2, 3])
    with pytest.raises(ValueError):
        ds.build(rows, ds.DatasetSpec())
    with pytest.raises(ValueError):
        ds.build(rows, ds.DatasetSpec(features=(ds.Feature("nothing"),), target=ds.Feature("parkinson")))
    with pytest.raises(ValueError):
        schema.validate({"lags": schema.ParamSpec("int", 0, 0, 5)}, {"lags": 9})
    with pytest.raises(ValueError):
        windows.forward_variance(horizon=0)
    with pytest.raises(KeyError):
        schema.DataBundle(a=1).require("b")


def test_range_estimators(spark):
    row = spark.createDataFrame([(100.0, 110.0, 95.0, 105.0)], "o double, h double, l double, c double")
    o, h, low, c = (F.col(x) for x in "ohlc")
    got = row.select(fm.parkinson(h, low), fm.garman_klass(o, h, low, c), fm.yang_zhang(o, h, low, c, F.lit(99.0))).first()
    hl, co, oo, k = math.log(110 / 95), math.log(1.05), math.log(100 / 99), 0.34 / 1.34
    assert got[0] == pytest.approx(hl**2 / (4 * math.log(2)))
    assert got[1] == pytest.approx(0.5 * hl**2 - (2 * math.log(2) - 1) * co**2)
    assert got[2] == pytest.approx(k * oo**2 + (1 - k) * co**2 + 0.5 * hl**2)


def test_intraday_variance(spark):
    p = [100, 100.5, 101, 100.8, 101.2, 101.5]
    ticks = spark.createDataFrame([("SPY", T(2020, 1, 2, 9, 30) + dt.timedelta(minutes=30 * i), float(x)) for i, x in enumerate(p)] + [("ONE", T(2020, 1, 2), 5.0)], "entity_id string, ts timestamp, price double")
    got = {r.entity_id: r.rv for r in windows.intraday_variance(ticks).collect()}
    assert got["SPY"] == pytest.approx(np.sum(np.diff(np.log(p)) ** 2)) and got["ONE"] == 0.0


def test_normalise_keeps_the_last_and_renames(spark):
    rows = spark.createDataFrame([("A", "2020-01-01", 1.0, 1), ("A", "2020-01-01", 2.0, 2), ("A", "2020-01-02", float("nan"), 1), ("B", "2020-01-01", 5.0, 1)], "series_key string, obs_date string, close double, seq int")
    got = {(r.entity_id, r.ts_utc.day): r.close for r in panel.normalise(rows, ["close"], entities=["A"], order=("seq",)).collect()}
    assert got == {("A", 1): 2.0, ("A", 2): None}
    with pytest.raises(ValueError):
        panel.infer_keys(["x", "y"])
    with pytest.raises(KeyError):
        panel.normalise(rows, ["volume"])


def test_calendar(spark):
    day = spark.sql("select explode(sequence(date'2024-01-04', date'2024-01-08')) as d")
    got = [str(r[0]) for r in day.select(dates.next_trading_day(F.col("d"))).collect()]
    assert got == ["2024-01-05", "2024-01-08", "2024-01-08", "2024-01-08", "2024-01-09"]
    close = spark.range(1).select(dates.session_close_utc(F.lit("2024-07-01").cast("date")).cast("string").alias("t")).first().t
    assert close == "2024-07-01 20:00:00"
    assert dates.as_date("2024-01-02T03:00") == dt.date(2024, 1, 2) and dates.as_date(None) is None
    assert panel.parse_grid("sessions:XLON") == "XLON" and panel.parse_grid(None) == "XNYS"


def test_text():
    assert text.augmentations("all") == ["cumsum", "basepoint", "addtime", "leadlag"]
    assert text.augmentations("time -> leadlag,time") == ["addtime", "leadlag"] and text.augmentations("none") == []
    assert text.half_lives("2, 5,2") == [2.0, 5.0] and text.vendor_field("close") == "adjClose"
    assert len(text.schema_hash(["a"])) == 16 and text.schema_hash(["a", "b"]) != text.schema_hash(["b", "a"])
    with pytest.raises(ValueError):
        text.augmentations("wave")
    assert text.markdown(["a"], [[1]]).count("\n") == 3


def test_variants():
    names = ["const", "logret_0", "abslog_0", "sqlog_0"]
    assert panel.variant_columns(names, "ES") == ["const"]
    assert panel.variant_columns(names, "STES_AESE") == ["const", "abslog_0", "sqlog_0"]
    assert panel.variant_columns(names, "XGBSTES_BASE_MONO") == names
    assert panel.variant_columns(names, "MINE", {"MINE": {"raw"}}) == ["const", "logret_0"]


def test_metrics(spark):
    rows = spark.createDataFrame([("m", i, y, h) for i, (y, h) in enumerate([(0.1, 0.08), (0.2, 0.25)])], "model string, ts_utc int, y double, yhat double")
    got = metrics.by_model(rows, ["model"]).first()
    ratio = np.array([0.1 / 0.08, 0.2 / 0.25])
    assert got.qlike == pytest.approx(np.mean(ratio - np.log(ratio) - 1))
    assert got.rmse == pytest.approx(math.sqrt((0.02**2 + 0.05**2) / 2)) and got.mae == pytest.approx(0.035) and got.hit_rate == 1.0
    flat = metrics.by_model(rows.withColumn("yhat", F.lit(0.0)), ["model"]).first()
    assert flat["corr"] is None and flat.hit_rate is None


def test_recursions():
    r2 = np.array([0.01, 0.04, 0.09, 0.16, 0.25])
    assert recursion.smooth(r2, np.array([0.1, 0.2, 0.3, 0.4, 0.5]), 0.05)[0] == pytest.approx(0.046)
    assert recursion.initial_variance(np.array([1e-4, 4e-4, 9e-4, 1.0]), 3) == pytest.approx(14e-4 / 3)
    assert recursion.initial_variance(np.zeros(0)) == 1e-8
    x = pd.Series([np.nan, 1.0, 2.0, np.nan, np.nan, 4.0, 3.0])
    assert recursion.ewma(x.to_numpy(), 3.0) == pytest.approx(x.ewm(halflife=3.0, adjust=False).mean().to_numpy(), nan_ok=True)
    u, rho = np.array([1.0, 2.0, 3.0]), np.array([0.5, 0.5, 0.5])
    assert recursion.adjoint(u, rho).tolist() == [1 + 0.5 * (2 + 0.5 * 3), 2 + 0.5 * 3, 3]
    y = np.array([0.04, 0.05, 0.045, 0.042])
    h = recursion.pgarch(y, 0.05, 0.9, 0.2)
    assert h[1] == pytest.approx(0.1 * 0.05 + 0.9 * (0.2 * 0.04 + 0.8 * 0.04))
    assert (recursion.pgarch(y, 1e-30, 0.0, 0.1, least=0.01)[1:] == 0.01).all()


def test_constant_gate_path_is_the_state_shifted(spark):
    r = [1.0, 2.0, 3.0, 0.5, 0.2]
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(r)], "entity_id string, ts_utc int, r double")
    got = [x.yhat for x in recursion.smooth_by(rows, "r", 0.5).orderBy("ts_utc").collect()]
    v, want = 1.0, []
    for x in r:
        v = 0.5 * x * x + 0.5 * v
        want.append(v)
    assert got == pytest.approx(want)


def test_long_run_variance(spark):
    g = np.random.default_rng(0)
    d = g.normal(0.1, 1, 200)
    rows = spark.createDataFrame([("a", i, float(x), 0.0) for i, x in enumerate(d)], "entity_id string, ts_utc int, loss_a double, loss_b double")
    got = stats.with_p_value(stats.diebold_mariano(rows, ["entity_id"])).first()
    assert got.dm == pytest.approx(d.mean() / math.sqrt(stats.newey_west(d) / 200)) and got.n == 200 and 0 <= got.p <= 1
    assert stats.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and stats.student_p(-1.0, 5, "less") == pytest.approx(0.1816087, abs=1e-6)
    zero = stats.diebold_mariano(rows.withColumn("loss_a", F.lit(0.0)), ["entity_id"]).first()
    assert zero.dm is None


def test_calibration_regression(spark):
    g = np.random.default_rng(1)
    x = np.linspace(0.1, 1, 100)
    y = 0.02 + 1.5 * x + g.normal(0, 0.05, 100)
    rows = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, x, strict=True)], "model string, y double, yhat double")
    got = stats.mincer_zarnowitz(rows, ["model"]).first()
    design = np.column_stack([np.ones(100), x])
    beta, sse = np.linalg.lstsq(design, y, rcond=None)[:2]
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse[0] / 98)
    assert (got.alpha, got.beta) == pytest.approx(tuple(beta)) and (got.t_alpha, got.t_beta) == pytest.approx(tuple(beta / se))
    plain = stats.mincer_zarnowitz(rows, ["model"], constant=False).first()
    assert plain.beta == pytest.approx((x @ y) / (x @ x))


def test_quantile_bins_follow_pandas(spark):
    g = np.random.default_rng(3)
    x = np.round(g.exponential(size=300), 1)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    got = [r.bin for r in windows.quantile_bins(rows, "x", 10).orderBy("i").collect()]
    assert got == pd.qcut(x, 10, labels=False, duplicates="drop").tolist()


def test_event_path(spark):
    rows = spark.createDataFrame([("a", i, float(i * i)) for i in range(10)], "entity_id string, ts_utc int, x double")
    got = {r.offset: (r["mean"], r.n) for r in windows.event_path(rows, "x", F.col("ts_utc").isin(1, 4, 9), 2).collect()}
    assert got == {k: (float((4 + k) ** 2), 1) for k in range(-2, 3)}


def test_signatures(spark):
    path = np.array([[[0.0], [1.0], [3.0]]])
    s = signature.signature(path, 3)[0]
    assert s == pytest.approx([3, 4.5, 4.5])
    timed = signature.augment(path, ["addtime"])
    s = signature.signature(timed, 2)[0]
    assert s[3] + s[4] == pytest.approx(s[0] * s[1])
    assert signature.log_signature(timed, 2)[0][:2] == pytest.approx([1, 3])
    assert signature.rescaled(signature.signature(path, 3), 1, 3)[0] == pytest.approx([3, 9, 27])
    assert signature.augment(path, ["cumsum", "basepoint", "addtime", "leadlag"]).shape == (1, 7, 4)
    rows = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(np.random.default_rng(0).normal(size=40))], "entity_id string, ts_utc int, r double")
    made = signature.features(rows, ["r"], 5, 2, text.augmentations("all"))
    assert len([c for c in made.columns if c.startswith("sig")]) == 20
    assert made.filter(F.col("`sig.term=0`").isNotNull()).count() == 35
    fading = signature.fading_features(rows, half_lives=(2, 5), lags=4)
    assert fading.filter(F.col("`fsig.term=3`").isNotNull()).count() == 36
    with pytest.raises(ValueError):
        signature.features(rows, ["r"], 5, 6)


def test_lyndon_words_are_the_dimension_of_the_free_lie_algebra():
    for width in range(1, 7):
        for depth in range(1, 6):
            words = signature.lyndon_words(width, depth)
            assert len(words) == len(set(words)) == signature.lie_terms(width, depth)
            assert all(w < w[k:] + w[:k] for w in words for k in range(1, len(w)))
    assert [signature.lie_terms(2, d) for d in range(1, 6)] == [2, 3, 5, 8, 14] and signature.lie_terms(6, 2) == 21
    assert signature.bracket((0, 0, 1)) == {(0, 0, 1): 1, (0, 1, 0): -2, (1, 0, 0): 1}


@pytest.mark.parametrize("width, depth", [(1, 5), (2, 5), (3, 4), (4, 3), (6, 2), (5, 3)])
def test_lie_exponential_of_the_log_signature_is_the_signature(width, depth):
    """The brackets, each by its term, summed and exponentiated in the tensor algebra, give every word of the signature back."""
    path = np.random.default_rng(width).normal(size=(3, 7, width))
    terms = signature.log_signature(path, depth)
    assert terms.shape == (3, signature.lie_terms(width, depth))
    lie = [np.zeros((3, width**k)) for k in range(1, depth + 1)]
    for j, word in enumerate(w for own, *_ in signature.lie_basis(width, depth) for w in own):
        for w, c in signature.bracket(word).items():
            lie[len(w) - 1][:, int("".join(map(str, w)), width) if width > 1 else 0] += c * terms[:, j]
    total, power = [x.copy() for x in lie], [x.copy() for x in lie]
    for m in range(2, depth + 1):
        power = [sum(((power[j][:, :, None] * lie[k - 1 - j][:, None, :]).reshape(3, -1) for j in range(k)), np.zeros_like(lie[k])) / m for k in range(depth)]
        total = [t + p for t, p in zip(total, power, strict=True)]
    assert np.concatenate(total, axis=1) == pytest.approx(signature.signature(path, depth), abs=1e-9)


def test_log_signature_features_have_the_basis_s_columns(spark):
    rows = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(np.random.default_rng(3).normal(size=12))], "entity_id string, ts_utc int, r double")
    made = signature.features(rows, ["r"], 5, 3, ("addtime",), log=True)
    assert [c for c in made.columns if c.startswith("sig")] == [f"sig.term={j}" for j in range(5)]
    plain = signature.features(rows, ["r"], 5, 2, ("addtime",), rescale=False).select(F.col("`sig.term=5`").alias("x")).dropna().collect()
    twice = signature.features(rows, ["r"], 5, 2, ("addtime",)).select(F.col("`sig.term=5`").alias("x")).dropna().collect()
    assert [2 * a[0] for a in plain] == pytest.approx([b[0] for b in twice]) and len(plain) == 7


def test_folds(spark):
    got = [tuple(r) for r in folds.walk_forward(spark, 1000, "rolling", 500, 100, 200).collect()]
    assert got == [(0, 0, 500, 600), (1, 200, 700, 800), (2, 400, 900, 1000)]
    assert folds.walk_forward(spark, 1000, "expanding", 500, 100, 200, 1).count() == 1 and folds.walk_forward(spark, 10).count() == 0
    with pytest.raises(ValueError):
        folds.walk_forward(spark, 10, "sideways")


def test_diagnostics(spark):
    rows = spark.createDataFrame([(1, 3.0), (2, -5.0), (3, 1.0)], "t int, x double")
    assert [r.t for r in diagnostics.top_by_size(rows, "x", 2, "t").collect()] == [2, 1]
    table = diagnostics.coefficient_table(spark.createDataFrame([(0.5, -2.0, 0.0)], "a double, b double, c double"), ["a", "b", "c"])
    assert [(r.name, r.effect) for r in table.collect()] == [("b", "lowers gate"), ("a", "raises gate"), ("c", "none")]


def forecast_rows(spark, n=50):
    g = np.random.default_rng(42)
    y = g.uniform(0.5, 2, n)
    days = pd.date_range("2025-01-01", periods=n)
    f = [(f"{m}:0001", "SPY", d.to_pydatetime(), d.to_pydatetime(), 1, float(v + g.normal(0, s))) for m, s in (("Good", 0.05), ("Bad", 0.5)) for d, v in zip(days, y, strict=True)]
    a = [("SPY", d.to_pydatetime(), 1, float(v)) for d, v in zip(days, y, strict=True)]
    return spark.createDataFrame(f, "model_id string, ticker string, asof_utc timestamp, target_utc timestamp, horizon int, yhat double"), spark.createDataFrame(a, "ticker string, target_utc timestamp, horizon int, y double")


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.read("actuals").count() == 0 and s.leaderboard("SPY", "2025-03-01").count() == 0
    f, a = forecast_rows(spark)
    for _ in range(2):
        s.upsert_forecasts(f)
        s.upsert_actuals(a.unionByName(a.limit(1).withColumn("y", F.lit(float("nan"))).withColumn("ticker", F.lit("X"))))
    assert s.read("forecasts").count() == 100 and s.read("actuals").count() == 50
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    files = lambda month: sorted(p for p in s.log("actuals").paths(s.log("actuals").at()[1], {f"month={month}"}))
    before, other = files("2025-01-01"), files("2025-02-01")
    s.upsert_actuals(a.filter("target_utc = '2025-01-02'").withColumn("y", F.lit(9.0)))
    assert files("2025-02-01") == other and len(files("2025-01-01")) == len(before) + 1  # an upsert adds to its own months only
    assert [r.y for r in s.read("actuals", "SPY", "2025-01-02", "2025-01-02").collect()] == [9.0] and s.read("actuals").count() == 50
    s.compact("actuals", ["2025-01-15"])
    assert len(files("2025-01-01")) == 1 and [p.split("/month=")[0] for p in files("2025-02-01")] == [p.split("/month=")[0] for p in other] and s.read("actuals").count() == 50
    assert [r.y for r in s.read("actuals", "SPY", "2025-01-02", "2025-01-02").collect()] == [9.0]
    s.upsert_actuals(a)
    board = s.leaderboard("SPY", "2025-03-01", primary="rmse").orderBy("rank").collect()
    assert [r.model for r in board] == ["Good", "Bad"] and board[0].n_obs == 50
    assert s.register("ES", {"a": 1}, "2020-01-01", "2020-06-01", columns=("const",), created="2020-06-01") == "ES:0001"
    assert s.register("ES", {"a": 2}, "2020-01-01", "2020-07-01") == "ES:0002"
    assert s.latest_model_id("ES") == "ES:0002" and s.latest_model_id("none") is None and s.model("none") is None
    assert '"schema_hash"' in s.model("ES:0001")["params_json"] and s.history("ES").count() == 2
    assert s.fetch_forecasts("SPY", "2025-01-02", "2025-01-03").count() == 4
    names = spark.createDataFrame([("ES",), ("new",)], "model_type string")
    due = lambda **k: {r.model_type: r.refit for r in store.refit_due(s.read("models"), names, F.lit("2020-07-10").cast("date"), **k).collect()}
    assert due(n_days=30) == {"ES": False, "new": True} and due(n_days=5) == {"ES": True, "new": True}
    assert due(policy="always_load") == {"ES": False, "new": True} and due(force=True) == {"ES": True, "new": True}
    assert due(policy=lambda age, model_id: model_id.isNull() | (age > 8)) == {"ES": True, "new": True} and due(policy=lambda age, _: age > 9) == {"ES": False, "new": None}
    with pytest.raises(ValueError):
        due(policy="sometimes")
    assert store.policy_for({"training": {"refit_policy": {"type": "expanding_window"}}, "models": {"m": {"refit_policy": {"type": "every_n_days", "params": {"n_days": 3}}}}}, "m") == {"policy": "every_n_days", "n_days": 3}
    with pytest.raises(ValueError):
        store.check_columns(["a", "b"], ["b", "a"])


def vendor(spark, calls):
    def fetch(entities, start, end):
        calls.append((tuple(entities), start, end))
        days = pd.bdate_range(start, end)
        rows = [(e, str(d.date()), *[100.0 + i] * 4, 10.0, *[50.0 + i] * 4) for e in entities for i, d in enumerate(days)]
        return spark.createDataFrame(rows, "ticker string, date string, open double, high double, low double, close double, volume double, adjOpen double, adjHigh double, adjLow double, adjClose double")

    return fetch


def test_cached_source(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    calls = []
    source = eod.CachedSource(vendor(spark, calls), str(tmp_path / "cache"), "update")
    q = schema.Query("market.ohlcv", ("close", "volume"), "2021-01-04", "2021-01-08", ("SPY",))
    got = source.fetch(spark, q).data.collect()
    assert len(got) == 5 and got[0].close == 50.0 and got[0].ts_utc == T(2021, 1, 4)
    assert source.fetch(spark, q).data.count() == 5 and len(calls) == 1
    wider = schema.Query("market.ohlcv", ("close",), "2021-01-04", "2021-01-12", ("SPY",))
    assert source.fetch(spark, wider).data.count() == 7 and calls[-1][1] == "2021-01-09"
    with pytest.raises(ValueError):
        source.fetch(spark, schema.Query("market.ohlcv", ("close",)))
    with pytest.raises(KeyError):
        source.fetch(spark, schema.Query("other", ("close",), 1, 2, ("A",)))
    with pytest.raises(ValueError):
        eod.OHLCV_TABLE.check(["bid"])


def test_registry(spark):
    rows = prices(spark, [100, 101, 103])
    r = registry.Registry(spark, registry.FrameSource({"market.ohlcv": rows}), simulated.SimulatedSource(n=60))
    q = schema.Query("market.ohlcv", ("close",), "2020-01-01", "2020-01-02", ("AAA",))
    assert r.load(q).data.count() == 2
    sim = schema.Query("market.ohlcv", ("close", "open"), None, None, ("SIM7",))
    assert r.load(sim, "simulated").data.count() == 60
    assert simulated.SimulatedSource(n=20).fetch_series(spark, sim).columns[:2] == ["obs_date", "series_key"]
    with pytest.raises(LookupError):
        r.load(schema.Query("nothing", ("x",)))


def test_simulation_is_deterministic(spark):
    a, b = (simulated.simulate(spark, [3, 4], n=80).orderBy("entity_id", "ts_utc").collect() for _ in range(2))
    assert a == b and len(a) == 160 and a[0].high == a[0].low


def test_race(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    bars = simulated.simulate(spark, [1, 2], n=160).cache()
    config = {"models": {"ES": {"kind": "es"}, "STES": {"kind": "stes", "columns": ["abs_r"], "params": {"restarts": 1}}}, "training": {"min_history_days": 50, "refit_policy": {"type": "every_n_days", "params": {"n_days": 10}}}}
    s = store.Store(spark, str(tmp_path / "store"))
    out = race.run(spark, bars, s, config, "2000-06-01 00:00:00").collect()
    assert len(out) == 4 and {str(r.target) for r in out} == {"2000-06-02"} and all(r.yhat > 0 for r in out)
    fits = s.read("artifacts").count()
    assert fits == 4 and {r.metric_name for r in s.read("models").collect()} == {"train_mse"}
    broken = {m: c | {"params": {"restarts": 0}} for m, c in config["models"].items()}  # a fit would fail
    second = race.run(spark, bars, s, config | {"models": broken}, "2000-06-02 00:00:00").collect()
    assert s.read("models").count() == 2 and s.read("forecasts").count() == 8 and s.read("artifacts").count() == fits
    by_hand = fanout.apply(race.observations(bars, "2000-06-02 00:00:00"), s.artifacts("STES:0001").withColumn("model", F.lit("STES")), {"STES": config["models"]["STES"]})
    newest = {r.entity_id: r.yhat for r in by_hand.groupBy("entity_id").agg(F.max_by("yhat", "ts_utc").alias("yhat")).collect()}
    assert newest == {r.entity_id: r.yhat for r in second if r.model == "STES"}
    with pytest.raises(Exception, match="fitted on"):
        fanout.apply(race.observations(bars, "2000-06-02 00:00:00"), s.artifacts("STES:0001").withColumn("model", F.lit("STES")), {"STES": {"kind": "stes", "columns": ["r"]}}).collect()
    more = bars.unionByName(simulated.simulate(spark, [3], n=160))
    third = race.run(spark, more, s, config, "2000-06-02 00:00:00").collect()  # a series that no fit has seen
    assert len(third) == 6 and s.read("artifacts").count() == fits + 2 and s.read("models").count() == 2
    race.run(spark, bars, s, config, "2000-06-05 00:00:00", force=True, only=["ES"])
    assert s.latest_model_id("ES") == "ES:0002"
    board = s.leaderboard("SIM1", "2000-06-05 00:00:00").collect()
    assert {r.model for r in board} == {"ES", "STES"}
    with pytest.raises(ValueError):
        race.registry({"models": {"x": {"kind": "oracle"}}})


def test_walk_forward_and_benchmark(spark):
    rows = simulated.simulate(spark, [5], n=140).withColumn("r", F.col("ret")).withColumn("y", F.pow(F.lead("ret").over(windows.by_entity()), 2)).dropna(subset=["y"])
    rows = panel.to_steps(rows).cache()
    specs = {"ES": {"kind": "es"}, "GARCH": {"kind": "garch"}}
    made = race.walk_forward(rows, specs, every=20, first=100).cache()
    assert made.groupBy("model").count().collect()[0]["count"] == 39 and made.select("step").distinct().count() == 39
    out = race.benchmark(made, "ES", 100)
    assert out["metrics"].count() == 2 and out["dm"].count() == 1 and out["mz"].count() == 2
    assert race.compare(made, made).first().improvement == 0


def test_cli(spark, tmp_path):
    from tidemark.cli import main

    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    simulated.simulate(spark, [1], n=120).write.parquet(str(tmp_path / "bars"))
    (tmp_path / "c.yaml").write_text("models:\n  ES: {kind: es}\ntraining: {min_history_days: 50}\n")
    base = ["--config", str(tmp_path / "c.yaml"), "--bars", str(tmp_path / "bars"), "--store", str(tmp_path / "s")]
    assert main([*base, "run", "--date", "2000-05-01"], spark) == 0
    assert main([*base, "backfill", "--start", "2000-05-02", "--end", "2000-05-03"], spark) == 0
    assert main([*base, "leaderboard", "--ticker", "SIM1", "--date", "2000-05-03"], spark) == 0
    assert store.Store(spark, str(tmp_path / "s")).read("forecasts").count() == 3


def test_data_sources_and_table_functions(spark, tmp_path):
    import json

    from tidemark.sources import datasource

    for e, base in (("AAA", 10.0), ("BBB", 20.0)):
        (tmp_path / f"{e}.json").write_text(json.dumps([{"date": f"2021-01-0{k}T00:00:00Z", "close": base + k, "adjClose": base} for k in range(4, 9)]))
    datasource.register(spark)
    fetch = datasource.vendor_rows(spark, f"file://{tmp_path}/{{entity}}.json")
    got = fetch(["AAA", "BBB"], "2021-01-04", "2021-01-08")
    assert got.rdd.getNumPartitions() == 2 and got.count() == 10 and got.filter("open is null").count() == 10
    cached = eod.CachedSource(fetch, str(tmp_path / "cache"), "update")
    rows = cached.fetch(spark, schema.Query("market.ohlcv", ("close",), "2021-01-04", "2021-01-08", ("AAA", "BBB"))).data.collect()
    assert sorted({(r.entity_id, r.close) for r in rows}) == [("AAA", 10.0), ("BBB", 20.0)] and len(rows) == 10
    with pytest.raises(Exception, match="required"):
        spark.read.format("tidemark_eod").options(url="x").load().collect()
    with pytest.raises(Exception):
        datasource.vendor_rows(spark, f"file://{tmp_path}/none-{{entity}}.json", retries="1")(["X"], "2021-01-04", "2021-01-05").collect()
    sim = spark.read.format("tidemark_garch").options(seeds="7", n="50").load().orderBy("step").collect()
    assert [r.ret for r in sim] == simulated.path(50, 7)[0].tolist()
    assert [str(r.day) for r in spark.sql("SELECT * FROM business_days(DATE'2021-01-01', DATE'2021-01-05')").collect()] == ["2021-01-01", "2021-01-04", "2021-01-05"]
    assert [tuple(r) for r in spark.sql("SELECT * FROM expanding_folds(10, 4, 3)").collect()] == [(0, 0, 4, 7), (1, 0, 7, 10)]


def test_coverage_and_members(spark):
    rows = prices(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    panel.assert_coverage(rows, "2020-01-01", "2020-01-14")
    with pytest.raises(ValueError, match="AAA"):
        panel.assert_coverage(rows, "2020-01-01", "2020-03-01")
    assert panel.members(rows, spark.createDataFrame([("BBB",)], "entity_id string"), "entity_id").count() == 0
    assert dates.fetch_start("2020-01-06", 2) == "2020-01-02"


def test_exact_quantiles(spark):
    from tidemark.operators.quantiles import exact

    g = np.random.default_rng(9)
    for values in (g.normal(size=5000), g.exponential(size=3000) ** 6, np.repeat([1.0, 2.0, 7.0], 900), np.array([3.0]), np.concatenate([np.zeros(2000), g.normal(size=500) * 1e-9, [1e12]])):
        frame = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
        shares = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
        assert exact(frame, "x", shares, few=50) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12, abs=1e-18)
    assert exact(frame.limit(0), "x", [0.5]) == []


@pytest.mark.parametrize(
    "values",
    [
        [*range(20), float("inf")], [float("-inf")] * 7 + [float("inf")] * 5, [float("inf")] * 9, [1e308, -1e308, *(x / 7 for x in range(60))],
        [2.0**-k for k in range(1070)], [1 + 2.0**-k for k in range(52)] * 5 + [float("-inf")], [5e-324, 1e-323, 1.5e-323, 0.0, -0.0] * 9, [1.0] * 300 + [1e-300, 2.0, float("nan")],
    ],
)
def test_exact_quantiles_end_for_any_values(spark, values):
    """Infinite values, differences that overflow, values of every magnitude, denormal ones: as by sorting, and no endless rounds."""
    from tidemark.operators.quantiles import exact

    frame = spark.createDataFrame([(float(x),) for x in values], "x double")
    kept = sorted(float(x) for x in values if x == x)
    for p, got in zip(shares := [0, 0.013, 0.25, 0.5, 0.75, 0.99, 1], exact(frame, "x", shares, few=5), strict=True):
        at = p * (len(kept) - 1)
        a, b = kept[int(at)], kept[min(int(at) + 1, len(kept) - 1)]
        share = at - int(at)
        want = a if a == b or not share else a * (1 - share) + b * share
        assert got == pytest.approx(want, rel=1e-12, nan_ok=True), p


def test_long_series_need_more_lags(spark):
    rows = spark.createDataFrame([("a", i, float(i % 7)) for i in range(3000)], "entity_id string, ts_utc long, d double")
    assert stats.long_run_variance(rows, "d", ["entity_id"]).first().lags == 8
    with pytest.raises(Exception, match="most_lags"):
        stats.long_run_variance(rows, "d", ["entity_id"], most_lags=4).collect()


def test_candidates(spark):
    from tidemark.plans import validation

    every = validation.families(["abs_r"])
    assert {c.family for c in every} == {"screening", "boosting", "recurrent"}
    assert [c.name for c in validation.chosen(every, ["boost_g"])] == ["boost_g"] and len(validation.chosen(every, family="recurrent")) == 3
    assert '"boost_g"' in validation.manifest(every)
    for wrong in (lambda: validation.chosen(every, ["none"]), lambda: validation.Candidate("x", "y", {"kind": "z"})):
        with pytest.raises(ValueError):
            wrong()
    rows = simulated.simulate(spark, [5, 6], n=300).withColumn("r", F.col("ret")).withColumn("abs_r", F.abs("ret")).withColumn("y", F.pow(F.lead("ret").over(windows.by_entity()), 2)).dropna(subset=["y"])
    rows = panel.to_steps(rows).cache()
    made = validation.rolling_forecasts(rows, {"ES": {"kind": "es"}, "GARCH": {"kind": "garch"}}, 120, 50, 60).cache()
    assert sorted({(r.window_no, r.n, r.a) for r in made.groupBy("entity_id", "window_no", "model").agg(F.count("*").alias("n"), F.min("step").alias("a")).collect()}) == [(0, 50, 120), (1, 50, 180), (2, 50, 240)]
    out = validation.candidate_rows(made, "GARCH", ["ES"], ["entity_id", "window_no"]).collect()
    assert len(out) == 6 and all(r.rank in (1, 2) and (r.rank == 1) == (r.gain_vs_ES >= 0) and 0 <= r.p_vs_ES <= 1 for r in out)
    tried = validation.try_candidates(rows, validation.chosen(every, ["screen_phi"]), {"ES": {"kind": "es"}}, 150, 100, 100).collect()
    assert {r.family for r in tried} == {"screening"} and all(r.runtime_seconds > 0 and r.n == 100 for r in tried)


def constant_variance(x, y, r, seed, share=1.0):
    class Model:
        def predict(self, x, y, r):
            return np.full(len(r), share * 2.0)

    return Model()


def test_custom_models(spark):
    rows = panel.to_steps(simulated.simulate(spark, [5], n=60).withColumn("r", F.col("ret")).withColumn("y", F.pow("ret", 2)))
    made = fanout.forecasts(rows, {"mine": {"kind": "custom", "factory": constant_variance, "params": {"share": 0.5}}})
    assert {r.yhat for r in made.collect()} == {1.0}
    fitted = fanout.fit_one({"kind": "custom", "factory": "tests.test_operators:constant_variance"}, np.ones((3, 1)), np.ones(3), np.ones(3))
    assert fitted(np.ones((2, 1)), np.ones(2), np.ones(2)).tolist() == [2.0, 2.0]


def test_snapshot(spark, tmp_path):
    from tidemark.sources.registry import load_snapshot

    prices(spark, [1, 2, 3, 4]).withColumn("y", F.col("close")).write.parquet(str(tmp_path / "snap"))
    parts = load_snapshot(spark, str(tmp_path / "snap"), 3)
    assert parts["all"].count() == 4 and parts["train"].count() == 3 and parts["train"].agg(F.max("y_scaled")).first()[0] == 30000.0
