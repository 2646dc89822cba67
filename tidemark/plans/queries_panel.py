"""Queries over panels, features and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, math, text
from ..operators import panel, windows
from .catalogue import query
from .panels import BARS, DATA, RETS, bars, dataset, returns, table, ticks

S = SparkSession
W = "OVER (PARTITION BY entity_id ORDER BY ts_utc)"


def r8(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {BARS} SELECT * FROM bars")
def bars_daily(spark: S, d: str) -> DataFrame:
    return bars(spark, d)


@query("""SELECT user_id, ts::DATE AS day, arg_max(value, row(ts, event_id)) AS value, arg_max(event_type, row(ts, event_id)) AS event_type FROM events
  GROUP BY 1, 2""")
def dedup_keep_last(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "value", "event_type")
    return panel.keep_last(rows, ["user_id", "day"], "ts", "event_id").drop("ts", "event_id")


@query("""SELECT event_type AS entity_id, ts, value AS price, event_id FROM events
  WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= (SELECT min(ts) + INTERVAL 20 DAY FROM events)""")
def pit_asof_filter(spark: S, d: str) -> DataFrame:
    events = ticks(spark, d).drop("user_id")
    asof = events.agg((F.min("ts") + F.expr("INTERVAL 20 DAYS")).alias("a")).first()["a"]
    return panel.time_range(events, "2024-01-03 00:00:00", None, str(asof), time="ts")


@query(f"""WITH {BARS} SELECT entity_id, ts_utc, close FROM bars WHERE ts_utc BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND entity_id IN ('A',
  'R')""")
def range_entity_filter(spark: S, d: str) -> DataFrame:
    kept = panel.entities_in(panel.time_range(bars(spark, d), "1995-01-01", "1996-12-31"), ["A", "R"])
    return panel.project(kept, ["entity_id", "ts_utc", "close", "close"])


@query("SELECT o_orderpriority AS entity_id, o_orderdate AS ts_utc, max(o_totalprice) AS price, count(*) AS n FROM orders GROUP BY 1, 2")
def normalised_panel(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_key"), F.col("o_orderdate").alias("obs_date")).agg(F.max("o_totalprice").alias("price"), F.count("*").alias("n"))
    return panel.normalise(rows.unionByName(rows.withColumn("price", F.col("price") - 1.0)), ["price", "n"], order=("price",)).drop("asof_utc")


@query(f"WITH {BARS} SELECT entity_id, ts_utc, open, high, low, close, volume FROM bars")
def canonical_ohlcv(spark: S, d: str) -> DataFrame:
    return panel.canonical_ohlcv(bars(spark, d).withColumn("extra", F.lit(1)))


@query(f"WITH {BARS} SELECT ts_utc, max(close) FILTER (entity_id = 'A') AS \"A\", max(close) FILTER (entity_id = 'N') AS \"N\", max(close) FILTER (entity_id = 'R') AS \"R\" FROM bars GROUP BY 1")
def pivot_close_wide(spark: S, d: str) -> DataFrame:
    return panel.pivot_field(bars(spark, d), "close", ["A", "N", "R"])


@query("""WITH e AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders), g AS (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS day FROM e)
SELECT day, count(o_orderkey) AS orders FROM g LEFT JOIN orders ON o_orderdate::DATE = day WHERE isodow(day) < 6 GROUP BY 1""")
def business_day_grid(spark: S, d: str) -> DataFrame:
    """Orders of each business day between the first and the last, also of days without one."""
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    a, z = orders.agg(F.min("day"), F.max("day")).first()
    grid = dates.business_days(spark, str(a), str(z))
    return grid.join(orders.groupBy("day").agg(F.count("*").alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("orders"))


@query("""SELECT DISTINCT o_orderdate::DATE AS day, (o_orderdate::DATE + CASE isodow(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::DATE AS next_day
  FROM orders""")
def next_trading_day(spark: S, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("next_day", dates.next_trading_day(F.col("day")))


_SESSIONS = "s AS (SELECT DISTINCT o_orderdate::DATE AS session FROM orders WHERE isodow(o_orderdate) < 6), g AS (SELECT day::DATE AS day FROM generate_series(DATE '1993-01-01', DATE '1995-12-31', INTERVAL 1 DAY) t(day))"


def _sessions(spark: S, d: str, direction: str) -> DataFrame:
    calendar = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("session")).distinct().filter(F.weekday("session") < 5)
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1993-01-01").cast("date"), F.lit("1995-12-31").cast("date"))).alias("day"))
    return dates.closest_session(days, calendar, direction)


@query(f"WITH {_SESSIONS} SELECT day, (SELECT min(session) FROM s WHERE session >= day) AS session FROM g")
def closest_next_session(spark: S, d: str) -> DataFrame:
    return _sessions(spark, d, "next")


@query(f"WITH {_SESSIONS} SELECT day, (SELECT max(session) FROM s WHERE session <= day) AS session FROM g")
def closest_previous_session(spark: S, d: str) -> DataFrame:
    return _sessions(spark, d, "previous")


@query(f"WITH {BARS} SELECT entity_id, min(ts_utc) AS first, max(ts_utc) AS last, count(*) AS n FROM bars GROUP BY 1")
def cache_coverage(spark: S, d: str) -> DataFrame:
    return panel.coverage(bars(spark, d))


@query(f"""WITH {DATA} SELECT entity_id, least(100, count(*))::BIGINT AS burn_in, count(*) AS train_end,
  count(*) FILTER (ts_utc < TIMESTAMP '1996-01-01') AS oos_start, count(*) AS oos_end FROM data GROUP BY 1""")
def train_oos_split(spark: S, d: str) -> DataFrame:
    return panel.positional_split(dataset(spark, d), "1996-01-01", 100)


@query(f"WITH {DATA} SELECT entity_id, ts_utc, step, round(100 * r, 8) AS ret, round(10000 * y, 3) AS y FROM data")
def scaled_target(spark: S, d: str) -> DataFrame:
    rows = panel.scale_up(dataset(spark, d).withColumnRenamed("r", "ret"))
    return r8(r8(rows.select("entity_id", "ts_utc", "step", "ret", "y"), "ret"), "y", digits=3)


@query(f"WITH {RETS} SELECT entity_id, ts_utc, round(coalesce(lead(r) {W}, r), 10) AS r_next FROM rets WHERE r IS NOT NULL")
def edge_padded_lead(spark: S, d: str) -> DataFrame:
    return r8(returns(spark, d).dropna(subset=["r"]).select("entity_id", "ts_utc", panel.lead_with_edge("r").alias("r_next")), "r_next", digits=10)


@query(f"""WITH {DATA}, m AS (SELECT entity_id, avg(r) AS mu, stddev_pop(r) AS s, avg(abs(r)) AS mu_a, stddev_pop(abs(r)) AS s_a FROM data
  WHERE ts_utc < TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT entity_id, ts_utc, round((r - mu) / s, 8) AS r, round((abs(r) - mu_a) / s_a, 8) AS abs_r, 1.0::DOUBLE AS const FROM data
  JOIN m USING (entity_id)""")
def standardized_features(spark: S, d: str) -> DataFrame:
    rows = dataset(spark, d).withColumn("abs_r", F.abs("r")).withColumn("const", F.lit(1.0))
    scaled = panel.standardise(rows, ["r", "abs_r", "const"], F.col("ts_utc") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return r8(scaled.select("entity_id", "ts_utc", "r", "abs_r", "const"), "r", "abs_r")


@query(f"""WITH {RETS}, s AS (SELECT entity_id, ts_utc, CASE WHEN count(r) OVER k = 6 THEN sum(r) OVER k END AS sig
  FROM rets WINDOW k AS (PARTITION BY entity_id ORDER BY ts_utc ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT entity_id, ts_utc, coalesce(round(sig, 8), 0) AS sig FROM s""")
def warmup_zero_fill(spark: S, d: str) -> DataFrame:
    rows = returns(spark, d)
    total = F.aggregate(windows.path("r", 5), F.lit(0.0), lambda a, x: a + x)
    sigs = rows.withColumn("sig", total).dropna(subset=["sig"])
    return r8(panel.fill_warm_up(rows.select("entity_id", "ts_utc"), sigs, ["sig"]), "sig")


@query(f"""WITH {BARS}, a AS (SELECT * FROM bars WHERE ts_utc < TIMESTAMP '1996-01-01'), b AS (SELECT entity_id, ts_utc, open, high, low, close + 1 AS close,
  volume FROM bars WHERE ts_utc >= TIMESTAMP '1995-06-01')
SELECT entity_id, ts_utc, close FROM b UNION ALL SELECT entity_id, ts_utc, close FROM a
  WHERE ts_utc < TIMESTAMP '1995-06-01' OR (entity_id, ts_utc) NOT IN (SELECT entity_id, ts_utc FROM b)""")
def cache_merge_keep_last(spark: S, d: str) -> DataFrame:
    from ..sources.eod import merge_cached

    rows = bars(spark, d).select("entity_id", "ts_utc", "close")
    cached, fetched = panel.time_range(rows, None, "1995-12-31 23:59:59"), panel.time_range(rows, "1995-06-01").withColumn("close", F.col("close") + 1)
    return merge_cached(cached, fetched)


@query(f"""WITH {BARS}, c AS (SELECT entity_id, min(ts_utc) AS a, max(ts_utc) AS b FROM bars
  WHERE ts_utc BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT entity_id, TIMESTAMP '1993-01-01' AS gap_from, a - INTERVAL 1 DAY AS gap_to, 'left' AS side FROM c WHERE a > TIMESTAMP '1993-01-01'
UNION ALL SELECT entity_id, b + INTERVAL 1 DAY, TIMESTAMP '1997-01-01', 'right' FROM c WHERE b < TIMESTAMP '1997-01-01'""")
def cache_gaps(spark: S, d: str) -> DataFrame:
    from ..sources.eod import gaps

    return gaps(panel.time_range(bars(spark, d), "1994-01-01", "1996-01-01"), "1993-01-01", "1997-01-01")


@query("""SELECT p_partkey::VARCHAR AS entity_id, DATE '2021-01-04'::TIMESTAMP AS ts_utc, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 END,
  p_retailprice) AS close FROM part""")
def vendor_mapping(spark: S, d: str) -> DataFrame:
    from ..sources.eod import from_vendor

    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("ticker"), F.lit("2021-01-04T15:30:00").alias("date"), F.col("p_retailprice").alias("close"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") * 2).alias("adjClose"))
    return from_vendor(rows, ["close"]).select("entity_id", F.col("ts_utc").cast("timestamp_ntz").alias("ts_utc"), "close")


@query(f"WITH {RETS} SELECT entity_id, ts_utc, round(r, 10) AS r FROM rets")
def log_return(spark: S, d: str) -> DataFrame:
    return r8(returns(spark, d).select("entity_id", "ts_utc", "r"), "r", digits=10)


def _lags(kind: str, form: str) -> str:
    cols = ", ".join(f"round({form.format(f'lag(r, {k}) {W}')}, 10) AS \"log{kind}.k={k}\"" for k in range(4))
    return f"WITH {RETS} SELECT entity_id, ts_utc, {cols} FROM rets"


def _lagged(spark: S, d: str, kind: str) -> DataFrame:
    cols = windows.lagged("close", 3, kind)
    return bars(spark, d).select("entity_id", "ts_utc", *(F.round(c, 10).alias(n) for n, c in cols.items()))


@query(_lags("ret", "{}"))
def lag_logret(spark: S, d: str) -> DataFrame:
    return _lagged(spark, d, "ret")


@query(_lags("abs", "abs({})"))
def lag_abslogret(spark: S, d: str) -> DataFrame:
    return _lagged(spark, d, "abs")


@query(_lags("sq", "pow({}, 2)"))
def lag_sqlogret(spark: S, d: str) -> DataFrame:
    return _lagged(spark, d, "sq")


@query(f"""WITH {BARS} SELECT entity_id, ts_utc, round(ln(close) - lag(ln(close), 5) {W}, 10) AS r5, round(ln(close) - lag(ln(close), 21) {W}, 10) AS r21
  FROM bars""")
def offset_logret(spark: S, d: str) -> DataFrame:
    return bars(spark, d).select("entity_id", "ts_utc", F.round(windows.log_return(k=5), 10).alias("r5"), F.round(windows.log_return(k=21), 10).alias("r21"))


@query(f"""WITH {BARS} SELECT entity_id, ts_utc, round(ln(high) - ln(low), 10) AS hl, round(pow(ln(high) - ln(low), 2) / (4 * ln(2)), 10) AS parkinson FROM bars""")
def hl_range(spark: S, d: str) -> DataFrame:
    return bars(spark, d).select("entity_id", "ts_utc", F.round(math.log_range(F.col("high"), F.col("low")), 10).alias("hl"), F.round(math.parkinson(F.col("high"), F.col("low")), 10).alias("parkinson"))


@query(f"""WITH {BARS} SELECT entity_id, ts_utc, round(0.5::DOUBLE * pow(ln(high) - ln(low), 2) - (2 * ln(2) - 1) * pow(ln(close) - ln(open), 2), 10) AS gk
  FROM bars""")
def garman_klass(spark: S, d: str) -> DataFrame:
    return bars(spark, d).select("entity_id", "ts_utc", F.round(math.garman_klass(*(F.col(c) for c in ("open", "high", "low", "close"))), 10).alias("gk"))


@query(f"""WITH {BARS} SELECT entity_id, ts_utc, round((0.34::DOUBLE / 1.34::DOUBLE) * pow(ln(open) - lag(ln(close)) {W},
  2) + (1 - 0.34::DOUBLE / 1.34::DOUBLE) * pow(ln(close) - ln(open), 2) + 0.5::DOUBLE * pow(ln(high) - ln(low), 2), 10) AS yz FROM bars""")
def yang_zhang(spark: S, d: str) -> DataFrame:
    before = F.lag("close").over(windows.by_entity())
    return bars(spark, d).select("entity_id", "ts_utc", F.round(math.yang_zhang(*(F.col(c) for c in ("open", "high", "low", "close")), before), 10).alias("yz"))


@query("""SELECT entity_id, day, round(coalesce(sum(m * m), 0), 8) AS rv FROM (SELECT event_type AS entity_id, ts::DATE AS day,
  ln(value) - lag(ln(value)) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS m FROM events) GROUP BY 1, 2""")
def intraday_rv(spark: S, d: str) -> DataFrame:
    return r8(windows.intraday_variance(ticks(spark, d), tiebreak=("event_id",)), "rv")


@query(f"WITH {BARS} SELECT entity_id, ts_utc, round(252 * pow(lead(ln(close)) {W} - ln(close), 2), 8) AS y FROM bars")
def nextday_sqret(spark: S, d: str) -> DataFrame:
    return bars(spark, d).select("entity_id", "ts_utc", F.round(windows.next_squared_return(scale=252.0), 8).alias("y"))


@query(f"""WITH {RETS} SELECT entity_id, ts_utc, CASE WHEN count(r) OVER f = 10 THEN round(sum(r * r) OVER f * 25.2::DOUBLE, 8) END AS rv
  FROM rets WINDOW f AS (PARTITION BY entity_id ORDER BY ts_utc ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)""")
def forward_rv(spark: S, d: str) -> DataFrame:
    return returns(spark, d).select("entity_id", "ts_utc", F.round(windows.forward_variance("r", 10, 252.0), 8).alias("rv"))


@query(f"""WITH {RETS} SELECT entity_id, ts_utc, round(r, 10) AS r, round(abs(r), 10) AS abs_r, round(r * r, 10) AS r2,
  round(CASE WHEN r < 0 THEN r * r ELSE 0 END, 10) AS neg_r2 FROM rets""")
def neg_r2_channels(spark: S, d: str) -> DataFrame:
    return returns(spark, d).select("entity_id", "ts_utc", *(F.round(c, 10).alias(n) for n, c in windows.channels(F.col("r")).items()))


@query(f"""WITH {BARS} SELECT entity_id, ts_utc, CASE WHEN count(close) OVER m = 2 THEN round(avg(close) OVER m, 8) END AS mean2
  FROM bars WINDOW m AS (PARTITION BY entity_id ORDER BY ts_utc ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")
def rolling_mean_2(spark: S, d: str) -> DataFrame:
    return bars(spark, d).select("entity_id", "ts_utc", F.round(windows.rolling_mean("close", 2), 8).alias("mean2"))


@query(f"""WITH {RETS} SELECT entity_id, ts_utc, round(s, 8) AS total, round(a, 8) AS first, n
  FROM (SELECT entity_id, ts_utc, sum(r) OVER k AS s, first_value(r) OVER k AS a, count(r) OVER k AS n FROM rets
  WHERE r IS NOT NULL WINDOW k AS (PARTITION BY entity_id ORDER BY ts_utc ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5""")
def path_matrix(spark: S, d: str) -> DataFrame:
    rows = returns(spark, d).withColumn("p", windows.path("r", 4)).dropna(subset=["p"])
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return rows.select("entity_id", "ts_utc", F.round(total, 8).alias("total"), F.round(F.get("p", F.lit(0)), 8).alias("first"), F.size("p").cast("long").alias("n"))


@query("""WITH RECURSIVE t AS (SELECT event_type AS entity_id, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT entity_id, k, x AS v FROM t WHERE k = 1 UNION ALL SELECT t.entity_id, t.k, pow(2::DOUBLE, -0.1::DOUBLE) * s.v + (1 - pow(2::DOUBLE,
  -0.1::DOUBLE)) * t.x FROM s JOIN t ON t.entity_id = s.entity_id AND t.k = s.k + 1)
SELECT entity_id, round(arg_max(v, k), 6) AS state, max(k) AS n FROM s GROUP BY 1""")
def ewma_terminal(spark: S, d: str) -> DataFrame:
    from ..operators.recursion import last_ewma

    keyed = ticks(spark, d).withColumn("t", F.struct("ts", "event_id"))
    return r8(last_ewma(keyed, "price", 10.0, "entity_id", "t"), "state", digits=6)


@query(f"""WITH {RETS}, f AS (SELECT entity_id, ts_utc, 1.0::DOUBLE AS const, r AS r0, lag(r) {W} AS r1, abs(r) AS a0, lag(abs(r)) {W} AS a1, pow(lead(r) {W},
  2) AS y, r AS ret FROM rets)
SELECT entity_id, ts_utc, const, round(r0, 10) AS "ohlcv_ret_log_k0", round(r1, 10) AS "ohlcv_ret_log_k1", round(a0,
  10) AS "ohlcv_absret_abs_log_k0", round(a1, 10) AS "ohlcv_absret_abs_log_k1", round(y, 10) AS y, round(ret, 10) AS ret
FROM f WHERE r0 IS NOT NULL AND r1 IS NOT NULL AND y IS NOT NULL""")
def vol_dataset(spark: S, d: str) -> DataFrame:
    from . import dataset as ds

    built = ds.build(bars(spark, d), ds.DatasetSpec(features=(ds.Feature("lag_log_return", {"lags": 1}), ds.Feature("lag_abs_log_return", {"lags": 1})), target=ds.Feature("next_day_squared_return", {})))
    rows = panel.add_const(built.rows)
    return rows.select("entity_id", "ts_utc", "const", *(F.round(F.col(f"`{c}`"), 10).alias(c) for c in [*built.features, "y", "ret"]))


@query("""SELECT * FROM (VALUES ('ohlcv_ret_log_k0', 'ret', 'log', 'close', 0), ('ohlcv_ret_log_k1', 'ret', 'log', 'close', 1), ('ohlcv_range_hl', 'range',
  'hl', 'high', 0), ('ohlcv_range_parkinson', 'range', 'parkinson', 'high', 0)) t(feature_id, family, transform, source_col, lag)""")
def feature_catalog(spark: S, d: str) -> DataFrame:
    from . import dataset as ds

    built = ds.build(bars(spark, d), ds.DatasetSpec(features=(ds.Feature("lag_log_return", {"lags": 1}), ds.Feature("high_low_range", {"parkinson": True})), target=ds.Feature("next_day_squared_return", {})))
    return built.catalog.select("feature_id", "family", "transform", "source_col", "lag")


@query(f"""WITH {DATA}, v(variant, columns, a, b, c) AS (VALUES ('ES', 'const', 0, 0, 0), ('STES_AE', 'const,logabs', 0, 1, 0), ('STES_SE', 'const,logsq', 0, 0, 1),
  ('STES_EAE', 'const,logret,logabs', 1, 1, 0), ('STES_EAESE', 'const,logret,logabs,logsq', 1, 1, 1), ('XGBSTES_BASE', 'const,logret,logabs,logsq', 1, 1, 1))
SELECT variant, columns, count(*) AS n, round(avg(1 + a * r + b * abs(r) + c * r * r), 8) AS mean_sum FROM data, v GROUP BY 1, 2""")
def variant_columns(spark: S, d: str) -> DataFrame:
    """The columns that each variant uses, and the mean of their sum over the rows."""
    r = F.col("r")
    rows = dataset(spark, d).select(F.lit(1.0).alias("const"), r.alias("logret"), F.abs(r).alias("logabs"), (r * r).alias("logsq"))
    used = {v: panel.variant_columns(rows.columns, v) for v in ("ES", "STES_AE", "STES_SE", "STES_EAE", "STES_EAESE", "XGBSTES_BASE")}
    each = [F.struct(F.lit(v).alias("variant"), F.lit(",".join(c)).alias("columns"), sum((F.col(x) for x in c), F.lit(0.0)).alias("s")) for v, c in used.items()]
    return r8(rows.select(F.explode(F.array(*each)).alias("v")).select("v.*").groupBy("variant", "columns").agg(F.count("*").alias("n"), F.avg("s").alias("mean_sum")), "mean_sum")


@query(f"""WITH {BARS}, w AS (SELECT entity_id, ts_utc FROM bars WHERE close > 1500) SELECT ts_utc, count(*) AS n, round(avg(close), 6) AS mean_close FROM bars
  WHERE ts_utc IN (SELECT ts_utc FROM w) GROUP BY 1""")
def membership_semi_join(spark: S, d: str) -> DataFrame:
    rows = bars(spark, d)
    return rows.join(rows.filter("close > 1500").select("ts_utc"), "ts_utc", "left_semi").groupBy("ts_utc").agg(F.count("*").alias("n"), F.round(F.avg("close"), 6).alias("mean_close"))


@query(f"""WITH {DATA} SELECT entity_id, ts_utc, strftime(ts_utc, '%Y-%m-%dT%H:%M:%S') AS stamp, 'm' || lpad(step::VARCHAR, greatest(4,
  len(step::VARCHAR))::INT, '0') AS model_id, 'es:0003' || chr(124) || entity_id || chr(124) || strftime(ts_utc,
  '%Y-%m-%dT%H:%M:%S') || chr(124) || strftime(ts_utc, '%Y-%m-%dT%H:%M:%S') || chr(124) || 'h1' AS forecast_id, 'es' AS model_type FROM data""")
def text_ids(spark: S, d: str) -> DataFrame:
    rows = dataset(spark, d)
    ts, es = F.col("ts_utc"), text.version_id(F.lit("es"), F.lit(3))
    return rows.select("entity_id", "ts_utc", text.stamp(ts).alias("stamp"), F.replace(text.version_id(F.lit("m"), F.col("step")), F.lit(":"), F.lit("")).alias("model_id"), text.forecast_id(es, F.col("entity_id"), ts, ts, F.lit(1)).alias("forecast_id"), text.model_type(es).alias("model_type"))


@query("""WITH z AS (SELECT event_id, (value - 50) / 10 AS z, value FROM events)
SELECT event_id, round(1 / (1 + exp(-z)), 10) AS sigmoid, round(ln(1 + exp(-abs(z))) + greatest(z, 0), 10) AS softplus,
  round(ln(least(greatest(value / 1000, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)) - ln(1 - least(greatest(value / 1000, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)),
  8) AS logit,
round(1e-4::DOUBLE + (1 - 2e-4::DOUBLE) / (1 + exp(-z)), 10) AS phi FROM z""")
def scalar_links(spark: S, d: str) -> DataFrame:
    z = (F.col("value") - 50) / 10
    return table(spark, d, "events").select("event_id", F.round(math.sigmoid(z), 10).alias("sigmoid"), F.round(math.softplus(z), 10).alias("softplus"), F.round(math.logit(F.col("value") / 1000, 1e-6), 8).alias("logit"), F.round(math.bounded_link(z), 10).alias("phi"))


@query("""WITH z AS (SELECT event_id, value / 100 AS y, value / 90 + 0.1::DOUBLE AS h FROM events)
SELECT event_id, round(0.5::DOUBLE * (h - y) * (h - y), 11) AS mse, round(sqrt(1 + (h - y) * (h - y)) - 1, 11) AS huber,
  round((h - y) / sqrt(1 + (h - y) * (h - y)), 11) AS huber_1, round(y / h - ln(y / h) - 1, 11) AS qlike, round((h - y) / (h * h), 11) AS qlike_1,
  round((2 * y - h) / (h * h * h), 11) AS qlike_2 FROM z""")
def loss_derivatives(spark: S, d: str) -> DataFrame:
    y, h = F.col("value") / 100, F.col("value") / 90 + 0.1
    mse, huber, qlike = (math.loss(y, h, k, eps=None) for k in ("mse", "huber", "qlike"))
    return table(spark, d, "events").select("event_id", *(F.round(c, 11).alias(n) for n, c in (("mse", mse[0]), ("huber", huber[0]), ("huber_1", huber[1]), ("qlike", qlike[0]), ("qlike_1", qlike[1]), ("qlike_2", qlike[2]))))


@query("""WITH p AS (SELECT p_partkey, 0.01::DOUBLE + p_retailprice / 1e6::DOUBLE AS mu, 0.9::DOUBLE + 0.09::DOUBLE * (p_partkey % 10) / 10 AS phi,
  0.05::DOUBLE + 0.01::DOUBLE * (p_partkey % 7) AS g FROM part)
SELECT p_partkey, round((1 - phi) * mu, 10) AS omega, round(phi * g, 10) AS alpha, round(phi * (1 - g), 10) AS beta FROM p""")
def implied_garch(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    mu, phi, g = 0.01 + F.col("p_retailprice") / 1e6, 0.9 + 0.09 * (k % 10) / 10, 0.05 + 0.01 * (k % 7)
    return table(spark, d, "part").select("p_partkey", *(F.round(c, 10).alias(n) for n, c in zip(("omega", "alpha", "beta"), math.implied_garch(mu, phi, g), strict=True)))


@query("""WITH o AS (SELECT o_orderpriority AS p, min(o_orderdate)::DATE AS a, count(DISTINCT o_orderdate::DATE) AS n FROM orders GROUP BY 1),
f AS (SELECT p, a, unnest(range(0, greatest((n - 20) // 500, 0))) AS fold FROM o),
b AS (SELECT p, unnest(generate_series(a, a + INTERVAL 60 DAY, INTERVAL 1 DAY)) AS day FROM o),
k AS (SELECT p, count(*) AS days FROM b WHERE isodow(day) < 6 GROUP BY 1)
SELECT p AS o_orderpriority, fold, 20 + 500 * fold AS train_to, 520 + 500 * fold AS val_to, days FROM f JOIN k USING (p)""")
def table_functions(spark: S, d: str) -> DataFrame:
    """Folds over each priority's days, and the business days of its first sixty, by table functions beside the rows that they are asked for."""
    from ..sources import datasource

    datasource.register(spark)
    days = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.count_distinct(F.to_date("o_orderdate")).alias("n"))
    return spark.sql(
        """WITH k AS (SELECT o_orderpriority, count(*) AS days FROM {days}, LATERAL business_days(a, date_add(a, 60)) GROUP BY 1)
        SELECT o_orderpriority, fold, train_to, val_to, days FROM {days}, LATERAL expanding_folds(n, 20, 500) JOIN k USING (o_orderpriority)""",
        days=days,
    )


@query()
def simulated_datasource(spark: S, d: str) -> DataFrame:
    """A simulated market for each nation, read as a data source with a partition a seed, and what its customers' balances would have earned there."""
    from ..sources import datasource

    datasource.register(spark)
    owned = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast("double")).alias("balance"), F.count("*").alias("customers"))
    seeds = ",".join(str(r["n_nationkey"]) for r in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect())  # a fixed table
    rows = spark.read.format("tidemark_garch").options(seeds=seeds, n="400").load().withColumn("c_nationkey", F.replace("entity_id", F.lit("SIM")).cast("int"))
    made = rows.join(owned, "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.first("customers").alias("customers"), F.sum(F.col("ret") / 100 * F.col("balance")).alias("earned"), F.avg("sigma2").alias("sigma2"))
    return r8(made, "earned", "sigma2", digits=6)
