"""Queries over sources, sinks, the store, the race and streams, each through the operator as a user calls it."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import diagnostics, metrics, panel, recursion, store, windows
from ..schema import Query
from ..sources import eod, registry, shared
from ..streaming import states
from . import dataset as ds
from . import race
from .catalogue import query
from .panels import BARS, DATA, ES, RETS, bars, dataset, returns, smoothed, table
from .queries_evaluation import _GATES, _gates, _long
from .queries_panel import r8

S = SparkSession
W = "OVER (PARTITION BY entity_id ORDER BY ts_utc)"


def _folder(spark: S, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}"


_SUNDAY = "make_date(year({d}), {m}, 1) + ((7 - isodow(make_date(year({d}), {m}, 1))) % 7)::INT"


@query(f"""WITH g AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders),
e AS (SELECT day, {_SUNDAY.format(d='day', m=4)} AS spring,
  CASE WHEN month({_SUNDAY.format(d='day', m=10)} + 28) = 10 THEN {_SUNDAY.format(d='day', m=10)} + 28 ELSE {_SUNDAY.format(d='day', m=10)} + 21 END AS autumn FROM g)
SELECT day, strftime(day + CASE WHEN day >= spring AND day < autumn THEN INTERVAL 20 HOUR ELSE INTERVAL 21 HOUR END, '%Y-%m-%d %H:%M') AS close_utc
  FROM e""")
def session_closes(spark: S, d: str) -> DataFrame:
    """The instant at which New York closes, by the summer time of these years."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    closes = panel.sessionise(days.withColumn("ts_utc", F.to_timestamp("day")), grid="sessions:XNYS")
    return closes.select("day", F.date_format("ts_utc", "yyyy-MM-dd HH:mm").alias("close_utc"))


@query("""SELECT date_trunc('hour', ts) AS date, round(value, 8) AS value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts)
  ORDER BY ts DESC, event_id DESC) = 1""")
def canonical_hours(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("date"), "ts", "event_id", "value")
    return r8(panel.canonical_index(rows, "date", ("ts", "event_id")).select("date", "value", "event_id"), "value")


@query(f"WITH {BARS} SELECT entity_id, ts_utc, close AS price, volume, 1.0::DOUBLE AS const FROM bars")
def prepared_panel(spark: S, d: str) -> DataFrame:
    renamed = panel.rename(bars(spark, d), {"close": "price", "absent": "x"})
    return panel.prepare(renamed, ["price", "volume"])


@query("""WITH v AS (SELECT event_type, event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS x FROM events)
SELECT event_type, count(*) FILTER (x IS NOT NULL AND NOT isnan(x)) AS n_complete, count(*) FILTER (x IS NOT NULL AND isfinite(x)) AS n_finite FROM v
  GROUP BY 1""")
def complete_and_finite(spark: S, d: str) -> DataFrame:
    k = F.col("event_id")
    x = F.when(k % 5 == 0, None).when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("inf")).otherwise(F.col("value"))
    rows = table(spark, d, "events").select("event_type", x.alias("x"))
    count = lambda df, name: df.groupBy("event_type").agg(F.count("*").alias(name))
    return count(panel.drop_any_missing(rows, ["x"]), "n_complete").join(count(panel.only_finite(rows, "x"), "n_finite"), "event_type")


@query(f"""WITH {BARS}, m AS (SELECT *, count(*) OVER k AS n, avg(close) OVER k AS mean FROM bars WINDOW k AS (PARTITION BY entity_id
  ORDER BY ts_utc ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) SELECT entity_id, ts_utc, close, CASE WHEN n = 2 THEN round(mean, 8) END AS mean_2 FROM m""")
def csv_round_trip(spark: S, d: str) -> DataFrame:
    """Bars written as CSV, read again by a schema, and their rolling mean."""
    folder = _folder(spark, "csv")
    registry.write_csv(bars(spark, d).select("entity_id", "ts_utc", F.col("close").alias("px")), folder)
    rows = registry.read_csv(spark, folder, "entity_id string, ts_utc timestamp_ntz, px double", {"px": "close"})
    return r8(rows.withColumn("mean_2", windows.rolling_mean("close", 2)), "mean_2")


@query(f"""WITH {BARS} SELECT entity_id, ts_utc, close,
  volume FROM bars WHERE ts_utc BETWEEN TIMESTAMP '1994-03-01' AND TIMESTAMP '1996-03-01' AND entity_id IN ('A', 'R')""")
def registry_scan(spark: S, d: str) -> DataFrame:
    """A stored table found by name after a source that does not have it; range, entities and columns reach the scan."""
    folder = _folder(spark, "tables")
    bars(spark, d).write.parquet(f"{folder}/market.ohlcv")
    found = registry.Registry(spark, registry.FrameSource({"other": bars(spark, d)}, "first"), registry.ParquetSource(folder))
    q = Query("market.ohlcv", ("close", "volume"), "1994-03-01", "1996-03-01", ("A", "R"))
    return found.load(q).data.select("entity_id", "ts_utc", "close", "volume")


@query(f"""WITH {BARS} SELECT entity_id, ts_utc::DATE AS day,
  close FROM bars WHERE ts_utc BETWEEN TIMESTAMP '1995-01-02' AND TIMESTAMP '1995-06-30' AND entity_id IN ('A', 'N')""")
def cached_prices(spark: S, d: str) -> DataFrame:
    """Prices fetched for one quarter, then for two, of which only the second is fetched again."""
    rows = shared.checkpoint(bars(spark, d).select(F.col("entity_id").alias("ticker"), F.date_format("ts_utc", "yyyy-MM-dd").alias("date"), "open", "high", "low", (F.col("close") + 1).alias("close"), "volume", F.col("close").alias("adjClose")))
    fetch = lambda entities, start, end: rows.filter(F.col("ticker").isin(list(entities)) & F.col("date").between(start[:10], end[:10]))
    source = eod.CachedSource(fetch, _folder(spark, "cache"), "update")
    for end in ("1995-03-31", "1995-06-30"):
        got = source.fetch(spark, Query("market.ohlcv", ("close",), "1995-01-02", end, ("A", "N"))).data
    return got.select("entity_id", F.to_date("ts_utc").alias("day"), "close")


@query("SELECT event_id, printf('%.4e', value) AS scientific, printf('%.1f', value * 100) || '%' AS percent FROM events WHERE value > 0")
def number_formats(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("value > 0")
    return rows.select("event_id", text.scientific(F.col("value"), 4).alias("scientific"), text.percent(F.col("value")).alias("percent"))


@query("""WITH l AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS c FROM part GROUP BY 1)
SELECT p_brand, '["' || array_to_string(c, '", "') || '"]' AS columns, substr(sha256('["' || array_to_string(c, '", "') || '"]'), 1, 16) AS schema_hash FROM l""")
def schema_hashes(spark: S, d: str) -> DataFrame:
    """The stable text and hash of a list of names for each brand."""

    @F.pandas_udf("columns string, schema_hash string")
    def hashed(lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(text.stable_json(list(c)), text.schema_hash(list(c))) for c in lists], columns=["columns", "schema_hash"])

    lists = table(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("c"))
    return lists.select("p_brand", hashed("c").alias("h")).select("p_brand", "h.*")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'cumsum,basepoint,addtime,leadlag' WHEN 1 THEN 'addtime,leadlag' WHEN 2 THEN 'cumsum,addtime' ELSE '' END AS augmentations
  FROM part""")
def parsed_lists(spark: S, d: str) -> DataFrame:
    parsed = F.udf(lambda s: ",".join(text.augmentations(s)), "string", useArrow=True)
    specs = F.element_at(F.array(*(F.lit(s) for s in ("all", "time + leadlag", "cumsum->time,time", "none"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", parsed(specs).alias("augmentations"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS day FROM orders""")
def coerced_dates(spark: S, d: str) -> DataFrame:
    """Dates given as days, as moments with a letter and as moments with a space."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    given = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T23:59:58"))).otherwise(F.concat(day, F.lit(" 00:00:01")))
    return table(spark, d, "orders").select("o_orderkey", F.udf(dates.as_date, "date", useArrow=True)(given).alias("day"))


_FEATURES = {"logret.k=0": "r", "logabs.k=1": "abs(r)", "logsq.k=2": "r * r", "SQ_abs": "abs(r) * abs(r)"}


@query(f"""WITH {DATA} SELECT feature_group, count(*) AS n, round(avg(x), 8) AS mean FROM (SELECT 'raw' AS feature_group, r AS x FROM data
  UNION ALL SELECT 'abs', abs(r) FROM data UNION ALL SELECT 'sq', r * r FROM data UNION ALL SELECT 'abs', abs(r) * abs(r) FROM data) GROUP BY 1""")
def feature_groups(spark: S, d: str) -> DataFrame:
    """Means by the group that a feature's name puts it in."""
    long = dataset(spark, d).select(F.explode(F.array(*(F.struct(F.lit(panel.feature_group(c)).alias("feature_group"), F.expr(e).alias("x")) for c, e in _FEATURES.items()))).alias("f"))
    return r8(long.select("f.*").groupBy("feature_group").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), "mean")


_RANGE = "pow(ln(high) - ln(low), 2)"


@query(f"""WITH {BARS}, t AS (SELECT *, ln(close) - lag(ln(close)) {W} AS ret, lag(ln(close)) {W} AS last FROM bars)
SELECT entity_id, ts_utc, round(ln(high) - ln(low), 8) AS hl, round({_RANGE} / (4 * ln(2)), 8) AS pk,
  round(0.5::DOUBLE * {_RANGE} - (2 * ln(2) - 1) * pow(ln(close) - ln(open), 2), 8) AS gk,
  round((0.34::DOUBLE / 1.34::DOUBLE) * pow(ln(open) - last, 2) + (1 - 0.34::DOUBLE / 1.34::DOUBLE) * pow(ln(close) - ln(open),
  2) + 0.5::DOUBLE * {_RANGE}, 8) AS yz FROM t WHERE ret IS NOT NULL""")
def range_templates(spark: S, d: str) -> DataFrame:
    """The range features, and the three range targets, as templates of a dataset."""
    rows = bars(spark, d)
    built = {t: ds.build(rows, ds.DatasetSpec(features=(ds.Feature("high_low_range", {"parkinson": True}),), target=ds.Feature(t))) for t in ("parkinson", "garman_klass", "yang_zhang")}
    keys, names = ["entity_id", "ts_utc"], built["parkinson"].features
    out = built["parkinson"].rows.select(*keys, F.col(names[0]).alias("hl"), F.col("y").alias("pk"))
    for name, t in (("gk", "garman_klass"), ("yz", "yang_zhang")):
        out = out.join(built[t].rows.select(*keys, F.col("y").alias(name)), keys)
    return r8(out, "hl", "pk", "gk", "yz")


@query(f"WITH {DATA} SELECT entity_id, ts_utc, round(y, 8) AS y, round(r, 8) AS ret FROM data")
def dataset_without_features(spark: S, d: str) -> DataFrame:
    built = ds.build(bars(spark, d), ds.DatasetSpec(target=ds.Feature("next_day_squared_return")))
    return r8(built.rows.select("entity_id", "ts_utc", "y", "ret"), "y", "ret")


@query(f"""WITH RECURSIVE {_GATES} SELECT entity_id, ts_utc, round(gate, 8) AS gate, round(last_abs_r, 8) AS last_abs_r
  FROM (SELECT *, abs(lag(r) {W}) AS last_abs_r FROM gm) WHERE last_abs_r IS NOT NULL""")
def shifted_gates(spark: S, d: str) -> DataFrame:
    return r8(diagnostics.shifted_gate(_gates(spark, d)).select("entity_id", "ts_utc", "gate", "last_abs_r"), "gate", "last_abs_r")


@query(f"""WITH RECURSIVE {ES}, o AS (SELECT * FROM es WHERE step >= 1000), {_long('o', 'entity_id, model')}, x AS (SELECT entity_id, model,
  round(max(abs(y - yhat)), 8) AS worst FROM o GROUP BY 1, 2)
SELECT mt.*, worst FROM mt JOIN x USING (entity_id, model)""")
def benchmark_metrics(spark: S, d: str) -> DataFrame:
    """The benchmark's table out of sample, with a metric of the user's own."""
    worst = F.max(F.abs(F.col("y") - F.col("yhat")))
    made = race.benchmark(smoothed(spark, d), "es_slow", 1000, extra={"worst": worst})["metrics"]
    return r8(made, "qlike", "rmse", "mae", "hit_rate", "corr", "worst")


@query(f"""WITH RECURSIVE {ES}, i AS (SELECT * FROM es WHERE step < 1000), {_long('i', 'entity_id, model')} SELECT * FROM mt""")
def benchmark_in_sample(spark: S, d: str) -> DataFrame:
    made = race.benchmark(smoothed(spark, d), "es_slow", 1000)["metrics_is"]
    return r8(made, "qlike", "rmse", "mae", "hit_rate", "corr")


@query(f"""WITH RECURSIVE {ES}, s AS (SELECT sqrt(avg(pow(y - yhat, 2)) FILTER (model = 'es_slow')) AS a, sqrt(avg(pow(y - yhat,
  2)) FILTER (model = 'es_fast')) AS b FROM es) SELECT round(a, 8) AS old, round(b, 8) AS new, round(a - b, 8) AS improvement, a - b > 0 AS promote
  FROM s""")
def old_against_new(spark: S, d: str) -> DataFrame:
    rows = smoothed(spark, d)
    return r8(race.compare(rows.filter("model = 'es_slow'"), rows.filter("model = 'es_fast'")), "old", "new", "improvement")


def _filled(spark: S, d: str, twice: bool = False) -> store.Store:
    """A store with all forecasts and outcomes; if ``twice``, the forecasts were others first."""
    kept = store.Store(spark, _folder(spark, "store"))
    f = smoothed(spark, d).select(F.concat("model", F.lit(":0001")).alias("model_id"), F.col("entity_id").alias("ticker"), F.to_timestamp("ts_utc").alias("asof_utc"), F.to_timestamp("ts_utc").alias("target_utc"), F.lit(1).alias("horizon"), "yhat")
    a = dataset(spark, d).select(F.col("entity_id").alias("ticker"), F.to_timestamp("ts_utc").alias("target_utc"), F.lit(1).alias("horizon"), "y")
    f = shared.checkpoint(f)
    kept.upsert_forecasts(f.withColumn("yhat", F.col("yhat") + 1) if twice else f)
    if twice:
        kept.upsert_forecasts(f)
    kept.upsert_actuals(a)
    return kept


@query(f"""WITH RECURSIVE {ES} SELECT model || ':0001' AS model_id, entity_id AS ticker, strftime(ts_utc, '%Y-%m-%d') AS day, round(yhat, 8) AS yhat FROM es
  WHERE entity_id = 'R' AND ts_utc BETWEEN TIMESTAMP '1995-02-01' AND TIMESTAMP '1995-08-31'""")
def store_round_trip(spark: S, d: str) -> DataFrame:
    """Forecasts written, written anew with other values, and fetched for one ticker and range."""
    rows = _filled(spark, d, twice=True).fetch_forecasts("R", "1995-02-01", "1995-08-31")
    return r8(rows.select("model_id", "ticker", F.date_format("target_utc", "yyyy-MM-dd").alias("day"), "yhat"), "yhat")


@query(f"""WITH RECURSIVE {ES}, j AS (SELECT * FROM es
  WHERE entity_id = 'N' AND ts_utc BETWEEN TIMESTAMP '1997-12-29' - INTERVAL 180 DAY AND TIMESTAMP '1997-12-29'),
t AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY model ORDER BY ts_utc DESC) <= 120), {_long('t', 'model')}
  SELECT *, row_number() OVER (ORDER BY rmse, model)::INT AS rank FROM mt""")
def store_leaderboard(spark: S, d: str) -> DataFrame:
    board = _filled(spark, d).leaderboard("N", "1997-12-29", 120, "rmse")
    return r8(board, "qlike", "rmse", "mae", "hit_rate", "corr")


@query(f"WITH {DATA} SELECT count(*) AS recorded, count(*) AS again, count(*) AS n FROM data")
def actuals_recorded(spark: S, d: str) -> DataFrame:
    """How many finite outcomes a store takes at the first and the second time, and how many it then has: written twice, they count once."""
    a = dataset(spark, d).select(F.col("entity_id").alias("ticker"), F.to_timestamp("ts_utc").alias("target_utc"), F.lit(1).alias("horizon"), "y")
    kept = store.Store(spark, _folder(spark, "store"))
    recorded, again = (kept.upsert_actuals(a.unionByName(a.limit(1).withColumn("horizon", F.lit(9)).withColumn("y", F.lit(float("nan"))))) for _ in range(2))
    return kept.read("actuals").agg(F.lit(recorded).cast("long").alias("recorded"), F.lit(again).cast("long").alias("again"), F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {ES}, y AS (SELECT * FROM (VALUES (1, DATE '1995-12-31'), (2, DATE '1996-12-31')) t(version, day))
SELECT 'ES:000' || version AS model_id, version, strftime(day, '%Y-%m-%d') AS trained, round(sqrt(avg(pow(y - yhat, 2))), 6) AS metric_value
  FROM es JOIN y ON ts_utc <= day WHERE model = 'es_fast' GROUP BY 1, 2, 3""")
def model_history(spark: S, d: str) -> DataFrame:
    """Versions of a model as they were registered, each with its error up to the end of its training."""
    kept, rows = store.Store(spark, _folder(spark, "store")), smoothed(spark, d).filter("model = 'es_fast'")
    for end in ("1995-12-31", "1996-12-31"):
        error = rows.filter(F.col("ts_utc") <= F.lit(end).cast("timestamp_ntz")).agg(metrics.rmse().alias("m")).first()["m"]
        kept.register("ES", {"kind": "es"}, None, end, ("rmse", error))
    kept.register("other", {"kind": "es"}, None, "1995-07-31")
    return r8(kept.history("ES").select("model_id", "version", F.date_format("trained_end", "yyyy-MM-dd").alias("trained"), "metric_value"), "metric_value", digits=6)


class Constant:
    """A model whose forecast is always the same."""

    def __init__(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, seed: int, value: float = 2.5):
        self.value = value

    def predict(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.full(len(r), self.value)


_CONFIG = {"models": {"CONST": {"kind": "custom", "factory": "tidemark.plans.queries_operators:Constant"}}, "training": {"min_history_days": 50}}
_NEXT = "(t::DATE + CASE isodow(t) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::DATE"


@query(f"""WITH {RETS}, l AS (SELECT entity_id, max(ts_utc) AS t FROM rets WHERE ts_utc <= TIMESTAMP '1997-03-03' GROUP BY 1)
  SELECT entity_id, 'CONST' AS model, {_NEXT} AS target, 2.5::DOUBLE AS yhat FROM l""")
def race_day(spark: S, d: str) -> DataFrame:
    """One day of the race with a model of the user's own: fitted, stored, and its forecast of the next session."""
    return race.run(spark, bars(spark, d), store.Store(spark, _folder(spark, "store")), _CONFIG, "1997-03-03 00:00:00")


@query(f"""WITH {RETS}, c AS (SELECT unnest([TIMESTAMP '1997-03-03', TIMESTAMP '1997-03-04', TIMESTAMP '1997-03-05']) AS cut), l AS (SELECT cut, entity_id,
  max(ts_utc) AS t FROM rets JOIN c ON ts_utc <= cut GROUP BY 1, 2)
SELECT 'CONST:0001' AS model_id, entity_id AS ticker, strftime(cut, '%Y-%m-%d') AS asof, {_NEXT} AS target, 2.5::DOUBLE AS yhat FROM l""")
def race_backfill(spark: S, d: str) -> DataFrame:
    """Three days of the race, of which only the first fits."""
    kept = store.Store(spark, _folder(spark, "store"))
    race.backfill(spark, shared.checkpoint(bars(spark, d)), kept, _CONFIG, "1997-03-03", "1997-03-05")
    return kept.read("forecasts").select("model_id", "ticker", F.date_format("asof_utc", "yyyy-MM-dd").alias("asof"), F.to_date("target_utc").alias("target"), "yhat")


class ScaledSmoother:
    """An exponential average of squares times the factor that is best on the training rows, by least squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, seed: int, gate: float = 0.1):
        self.gate = gate
        v = recursion.smooth(r * r, gate)
        self.factor = float((v * y).sum() / (v * v).sum())

    def predict(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
        return self.factor * recursion.smooth(r * r, self.gate)


_SCALED = {"models": {"SCALED": {"kind": "custom", "factory": "tidemark.plans.queries_operators:ScaledSmoother"}}, "training": {"min_history_days": 100, "refit_policy": {"type": "every_n_days", "params": {"n_days": 30}}}}
_SCALED_SQL = f"""{RETS}, x AS (SELECT entity_id, ts_utc, 100 * r AS r, lead(ts_utc) OVER w AS next_ts, lag(ts_utc) OVER w AS known_ts, pow(100 * lead(r) OVER w, 2) AS y,
  row_number() OVER w - 1 AS step FROM rets WHERE r IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY ts_utc)),
v AS (SELECT entity_id, step, r * r AS v FROM x WHERE step = 0
  UNION ALL SELECT x.entity_id, x.step, 0.1::DOUBLE * x.r * x.r + 0.9::DOUBLE * v.v FROM v JOIN x ON x.entity_id = v.entity_id AND x.step = v.step + 1),
d AS (SELECT day::DATE AS day, row_number() OVER (ORDER BY day) AS k FROM generate_series(DATE '1997-01-01', DATE '1997-03-26', INTERVAL 1 DAY) t(day) WHERE isodow(day) < 6),
a AS (SELECT day, k, entity_id, step, ts_utc, known_ts FROM x JOIN d ON ts_utc <= day AND (next_ts IS NULL OR next_ts > day) WHERE step >= 99),
e AS (SELECT day, k, max(known_ts) AS known FROM a GROUP BY 1, 2),
s AS (SELECT k, day, known AS trained, day AS fitted, 1 AS version FROM e WHERE k = 1
  UNION ALL SELECT e.k, e.day, CASE WHEN e.day - s.trained::DATE >= 30 THEN e.known ELSE s.trained END, CASE WHEN e.day - s.trained::DATE >= 30 THEN e.day ELSE s.fitted END,
  s.version + CASE WHEN e.day - s.trained::DATE >= 30 THEN 1 ELSE 0 END FROM s JOIN e ON e.k = s.k + 1),
f AS (SELECT g.version, b.entity_id, sum(v.v * x.y) / sum(v.v * v.v) AS factor FROM (SELECT DISTINCT version, fitted FROM s) g JOIN a b ON b.day = g.fitted
  JOIN x ON x.entity_id = b.entity_id AND x.step < b.step JOIN v ON v.entity_id = x.entity_id AND v.step = x.step GROUP BY 1, 2)
SELECT 'SCALED:' || lpad(s.version::VARCHAR, 4, '0') AS model_id, a.entity_id AS ticker, strftime(a.day, '%Y-%m-%d') AS asof, round(factor * v.v, 6) AS yhat
  FROM a JOIN s ON s.day = a.day JOIN f ON f.version = s.version AND f.entity_id = a.entity_id JOIN v ON v.entity_id = a.entity_id AND v.step = a.step"""


@query(f"WITH RECURSIVE {_SCALED_SQL}")
def race_backfill_fitted(spark: S, d: str) -> DataFrame:
    """Sixty-one days of the race in one job: a model that is fitted, stored, reloaded, fitted anew as it grows old, and run over each series."""
    kept = store.Store(spark, _folder(spark, "store"))
    race.backfill(spark, bars(spark, d), kept, _SCALED, "1997-01-01", "1997-03-26")
    return r8(kept.read("forecasts").select("model_id", "ticker", F.date_format("asof_utc", "yyyy-MM-dd").alias("asof"), "yhat"), "yhat", digits=6)


@query("WITH RECURSIVE " + _SCALED_SQL.replace("1997-01-01", "1997-03-03").replace("1997-03-26", "1997-03-04"))
def race_days_fitted(spark: S, d: str) -> DataFrame:
    """Two days of the race one by one: the second loads what the first one fitted."""
    kept = store.Store(spark, _folder(spark, "store"))
    race.backfill_by_day(spark, shared.checkpoint(bars(spark, d)), kept, _SCALED, "1997-03-03", "1997-03-04")
    return r8(kept.read("forecasts").select("model_id", "ticker", F.date_format("asof_utc", "yyyy-MM-dd").alias("asof"), "yhat"), "yhat", digits=6)


def stream(spark: S, d: str) -> DataFrame:
    """The ticks as a stream, with times that have a zone, as watermarks need them."""
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # a stream reads a pattern, not a file
    return rows.select(F.col("event_type").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))


def run_stream(spark: S, rows: DataFrame, name: str) -> DataFrame:
    folder = _folder(spark, name)
    rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@query("""WITH w AS (SELECT event_type AS entity_id, ts::DATE AS day, value AS r, max(ts) OVER () AS newest FROM events)
SELECT entity_id, day, round(sum(r * r), 4) AS rv, count(*) AS n FROM w GROUP BY 1, 2 HAVING day + INTERVAL 1 DAY <= max(newest) - INTERVAL 1 HOUR""")
def stream_daily_variance(spark: S, d: str) -> DataFrame:
    """Days of the stream that the watermark has closed."""
    rows = stream(spark, d).select("entity_id", "ts", F.col("price").alias("r"))
    return r8(run_stream(spark, states.daily_variance(rows), "daily"), "rv", digits=4)


@query("""WITH RECURSIVE e AS (SELECT event_type AS entity_id, ts, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k FROM events
  WHERE value > 0),
x AS (SELECT entity_id, k, ln(price) - lag(ln(price)) OVER (PARTITION BY entity_id ORDER BY ts) AS r FROM e),
s AS (SELECT entity_id, k, r * r AS v FROM x WHERE k = 2 UNION ALL SELECT x.entity_id, x.k, 0.06::DOUBLE * x.r * x.r + 0.94::DOUBLE * s.v FROM s
  JOIN x ON x.entity_id = s.entity_id AND x.k = s.k + 1)
SELECT entity_id, count(*) AS n, round(max(v), 7) AS highest, round(arg_max(v, k), 7) AS last FROM s GROUP BY 1""")
def stream_states(spark: S, d: str) -> DataFrame:
    """The variance that the stream carries for each entity."""
    rows = run_stream(spark, states.smoothed(stream(spark, d)), "states").filter("state is not null")
    return r8(rows.groupBy("entity_id").agg(F.count("*").alias("n"), F.max("state").alias("highest"), F.max_by("state", "k").alias("last")), "highest", "last", digits=7)


@query("SELECT event_type AS ticker, ts::DATE AS day, round(arg_max(value, ts), 8) AS y FROM events GROUP BY 1, 2")
def stream_upsert(spark: S, d: str) -> DataFrame:
    """The last tick of each day, as the stream has written it into a store."""
    kept, folder = store.Store(spark, _folder(spark, "store")), _folder(spark, "state")
    rows = stream(spark, d).select(F.col("entity_id").alias("ticker"), F.date_trunc("day", "ts").alias("target_utc"), F.lit(1).alias("horizon"), F.col("price").alias("y"), F.col("ts").alias("seen_utc"))
    states.upsert_stream(rows, kept, "actuals", folder).trigger(availableNow=True).start().awaitTermination()
    return r8(kept.read("actuals").select("ticker", F.to_date("target_utc").alias("day"), "y"), "y")


_G = "1 / (1 + exp(-({z})))"
_TREE_GATE = _G.format(z="-2 + CASE WHEN abs({d}.r) <= 0.5::DOUBLE THEN -0.3::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN {d}.r <= 0 THEN 0.2::DOUBLE ELSE -0.1::DOUBLE END")
_STES_GATE = _G.format(z="-2 + 3 * abs({d}.r) - 0.5::DOUBLE * {d}.r")
_PG = {"mu": "(1e-12::DOUBLE + ln(1 + exp(-1 + 0.2::DOUBLE * {d}.r)))", "phi": "(1e-4::DOUBLE + (1 - 2e-4::DOUBLE) / (1 + exp(-(2 - 0.1::DOUBLE * {d}.r))))", "g": "(1e-4::DOUBLE + (1 - 2e-4::DOUBLE) / (1 + exp(-(-2 + 0.3::DOUBLE * abs({d}.r)))))"}
_PGP = {k: v.format(d="p") for k, v in _PG.items()}
_STORED = f"""{DATA},
a AS (SELECT entity_id, step, ts_utc, {_STES_GATE.format(d='data')} AS gate, r * r AS v FROM data WHERE step = 0
  UNION ALL SELECT n.entity_id, n.step, n.ts_utc, {_STES_GATE.format(d='n')},
  {_STES_GATE.format(d='n')} * n.r * n.r + (1 - {_STES_GATE.format(d='n')}) * a.v FROM a
  JOIN data n ON n.entity_id = a.entity_id AND n.step = a.step + 1),
t AS (SELECT entity_id, step, ts_utc, {_TREE_GATE.format(d='data')} AS gate,
  {_TREE_GATE.format(d='data')} * r * r + (1 - {_TREE_GATE.format(d='data')}) * 1.5::DOUBLE AS v FROM data WHERE step = 0
  UNION ALL SELECT n.entity_id, n.step, n.ts_utc, {_TREE_GATE.format(d='n')},
  {_TREE_GATE.format(d='n')} * n.r * n.r + (1 - {_TREE_GATE.format(d='n')}) * t.v FROM t
  JOIN data n ON n.entity_id = t.entity_id AND n.step = t.step + 1),
p AS (SELECT entity_id, step, ts_utc, y, r, greatest(y, 1e-12::DOUBLE) AS v FROM data WHERE step = 0
  UNION ALL SELECT n.entity_id, n.step, n.ts_utc, n.y, n.r,
  greatest((1 - {_PGP['phi']}) * {_PGP['mu']} + {_PGP['phi']} * ({_PGP['g']} * p.y + (1 - {_PGP['g']}) * p.v), 1e-12::DOUBLE) FROM p
  JOIN data n ON n.entity_id = p.entity_id AND n.step = p.step + 1),
h AS (SELECT entity_id, step, ts_utc, r, 1.0::DOUBLE AS v FROM data WHERE step = 0
  UNION ALL SELECT n.entity_id, n.step, n.ts_utc, n.r, 0.05::DOUBLE + 0.1::DOUBLE * h.r * h.r + 0.85::DOUBLE * h.v FROM h
  JOIN data n ON n.entity_id = h.entity_id AND n.step = h.step + 1)
SELECT entity_id, ts_utc, 'STES' AS model, round(gate, 8) AS gate, round(v, 7) AS yhat FROM a UNION ALL
  SELECT entity_id, ts_utc, 'TREE', round(gate, 8), round(v, 7) FROM t
UNION ALL SELECT entity_id, ts_utc, 'PGARCH', round({_PGP['g']}, 8), round(v, 7) FROM p UNION ALL
  SELECT entity_id, ts_utc, 'GARCH', NULL, round(0.05::DOUBLE + 0.1::DOUBLE * r * r + 0.85::DOUBLE * v, 7) FROM h"""


@query(f"WITH RECURSIVE {_STORED}")
def stored_models(spark: S, d: str) -> DataFrame:
    """Forecasts and gates of four kinds of model with given parameters, by their artifacts as they are stored and loaded."""
    import pickle

    from ..models import boosting, fanout, pgarch, smoothing

    linear = pgarch.LinearPGarch(w=np.array([[-1.0, 2.0, -2.0], [0.2, -0.1, 0.0], [0.0, 0.0, 0.3]]))
    linear.mean, linear.scale = np.zeros(2), np.ones(2)
    tree = boosting.BoostedSmoother(base=-2.0)
    tree.model, tree.v0 = boosting.Booster(trees=[(1, 0.5, -0.3, 0.4), (0, 0.0, 0.2, -0.1)]), 1.5
    columns = ["r", "abs_r"]
    fitted = {
        "STES": fanout.Fitted("stes", smoothing.Smoother(["const", "r", "abs_r"], beta=np.array([-2.0, -0.5, 3.0])), columns),
        "TREE": fanout.Fitted("xgb_stes", tree, columns),
        "PGARCH": fanout.Fitted("pgarch", linear, columns),
        "GARCH": fanout.Fitted("garch", (0.05, 0.1, 0.85, 1.0), columns),
    }
    rows = dataset(spark, d).withColumn("abs_r", F.abs("r"))
    entities = shared.checkpoint(rows.groupBy("entity_id").agg(F.count("*").alias("n")))
    kept = store.Store(spark, _folder(spark, "store"))
    ids = {}
    for name, model in fitted.items():
        blob = F.lit(bytearray(pickle.dumps(model))).alias("artifact")
        ids[kept.register(name, {"kind": model.kind}, None, None, columns=tuple(columns), fitted=entities.select("entity_id", blob, F.lit(0.0).alias("loss"), "n"))] = name
    names = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    stored = kept.artifacts(*ids).withColumn("model", names[F.col("model_id")])
    made = fanout.apply(rows, stored, {n: {"kind": m.kind, "columns": columns} for n, m in fitted.items()})
    return r8(r8(made.select("entity_id", "ts_utc", "model", "gate", "yhat"), "gate"), "yhat", digits=7)


@query("""WITH z AS (SELECT event_id, (value - 50) / 40 AS z FROM events), s AS (SELECT *, ln(1 + exp(-abs(z))) + greatest(z, 0) AS sp, 1 / (1 + exp(-z)) AS sg
  FROM z)
SELECT event_id, round(sp + 1e-6::DOUBLE, 9) AS soft, round(exp(z), 6) AS exp_z, round(1e-12::DOUBLE + sp, 9) AS mu, round(sg, 9) AS mu_slope,
  round((1 - 2e-4::DOUBLE) * sg * (1 - sg), 9) AS phi_slope, round(z, 5) AS z_of_phi, round(z, 5) AS z_of_mu FROM s""")
def positive_links(spark: S, d: str) -> DataFrame:
    """Positive transforms, the links' slopes, and what their inverses give back."""
    from ..functions import math

    z = (F.col("value") - 50) / 40
    out = table(spark, d, "events").select("event_id", math.positive(z, eps=1e-6).alias("soft"), math.positive(z, "exp").alias("exp_z"), math.mu_link(z).alias("mu"), math.mu_slope(z).alias("mu_slope"), math.bounded_slope(z).alias("phi_slope"), math.bounded_inverse(math.bounded_link(z)).alias("z_of_phi"), math.mu_inverse(math.mu_link(z)).alias("z_of_mu"))
    out = out.withColumns({c: F.round(c, 5) + 0.0 for c in ("z_of_phi", "z_of_mu")})
    return r8(r8(out, "soft", "mu", "mu_slope", "phi_slope", digits=9), "exp_z", digits=6)


@query("""WITH m AS (SELECT event_type AS entity_id, user_id % 3 AS model, user_id AS seed, avg(value) AS oos_rmse FROM events GROUP BY 1, 2, 3)
SELECT entity_id, 'm' || model AS model, arg_min(seed, (oos_rmse, seed)) AS seed, round(min(oos_rmse), 8) AS oos_rmse FROM m GROUP BY 1, 2""")
def best_seeds(spark: S, d: str) -> DataFrame:
    from ..models import fanout

    made = table(spark, d, "events").groupBy(F.col("event_type").alias("entity_id"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("user_id").alias("seed")).agg(F.avg("value").alias("oos_rmse"))
    made = made.withColumns({"is_rmse": F.lit(0.0), "coefficients": F.create_map(F.lit("const"), F.lit(1.0))})
    return r8(fanout.best_seed(made).select("entity_id", "model", "seed", "oos_rmse"), "oos_rmse")


@query("""WITH c AS (SELECT unnest([struct_pack(name := 'slope', value := regr_slope(value, event_id)), struct_pack(name := 'intercept',
  value := regr_intercept(value, event_id)), struct_pack(name := 'none', value := 0.0::DOUBLE)]) AS x FROM events)
SELECT x.name AS name, round(x.value, 9) AS value,
  CASE WHEN x.value > 0 THEN 'raises gate' WHEN x.value < 0 THEN 'lowers gate' ELSE 'none' END AS effect FROM c""")
def coefficient_effects(spark: S, d: str) -> DataFrame:
    one = table(spark, d, "events").agg(F.regr_slope("value", "event_id").alias("slope"), F.regr_intercept("value", "event_id").alias("intercept"), F.lit(0.0).alias("none"))
    return r8(diagnostics.coefficient_table(one, ["slope", "intercept", "none"]), "value", digits=9)


@query(f"WITH RECURSIVE {ES} SELECT entity_id, ts_utc, round(yhat, 8) AS yhat FROM es WHERE model = 'es_mid' AND step >= 1200")
def warm_start(spark: S, d: str) -> DataFrame:
    """A smoother that goes on out of sample from the state in which the training rows leave it."""
    from ..models import smoothing
    from ..operators import recursion

    def go_on(group):
        r, cut = group["r"].to_numpy(float), int((group["step"] < 1200).sum())
        model, ones = smoothing.Smoother(["const"], beta=np.array([np.log(0.06 / 0.94)])), np.ones((len(r), 1))
        head = model.predict(ones[:cut], r[:cut])
        return {"yhat": np.concatenate([head, model.predict(ones[cut:], r[cut:], float(head[-1]) if cut else None)]) if cut < len(r) else head}

    rows = recursion.per_group(dataset(spark, d), ["entity_id"], ["ts_utc"], ["yhat"], go_on)
    return r8(rows.filter("step >= 1200").select("entity_id", "ts_utc", "yhat"), "yhat")
