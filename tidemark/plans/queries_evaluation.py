"""Queries over recursions, forecasts, the store, tests and diagnostics."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import math
from ..operators import diagnostics, folds, metrics, panel, recursion, signature, stats, store, windows
from . import validation
from .catalogue import query
from .panels import DATA, ES, RETS, dataset, returns, smoothed, table, ticks
from .queries_panel import r8

S = SparkSession
_RQ = "rmse, mae, qlike, corr, hit_rate"
_METRICS = """mv AS (SELECT *, lag(y) OVER k AS ly, lag(yhat) OVER k AS lh FROM {src} WINDOW k AS (PARTITION BY {by} ORDER BY ts_utc)),
sg AS (SELECT *, CASE WHEN ly > 0 THEN sign(y - ly) WHEN ly = 0 AND y > 0 THEN 1 END AS dy,
  CASE WHEN lh > 0 THEN sign(yhat - lh) WHEN lh = 0 AND yhat > 0 THEN 1 END AS dh,
  greatest(y, 1e-8::DOUBLE) / greatest(yhat, 1e-8::DOUBLE) AS q FROM mv),
mt AS (SELECT {by}, count(*) AS n_obs, round(avg(q - ln(q) - 1), 8) AS qlike, round(sqrt(avg(pow(y - yhat, 2))), 8) AS rmse,
  round(avg(abs(y - yhat)), 8) AS mae,
  round(avg(CASE WHEN dy IS NOT NULL AND dh IS NOT NULL THEN CASE WHEN dy = dh THEN 1.0::DOUBLE ELSE 0 END END), 8) AS hit_rate, round(corr(y, yhat),
  8) AS corr FROM sg GROUP BY {by})"""


def _long(src: str, by: str) -> str:
    return _METRICS.format(src=src, by=by)


_SCORES = "qlike", "rmse", "mae", "hit_rate", "corr"


@query(f"""WITH RECURSIVE {ES}, {_long('es', 'entity_id, model')},
b AS (SELECT model, sum(n_obs)::BIGINT AS n_obs, {", ".join(f"round(avg({c}), 7) AS {c}" for c in _SCORES)} FROM mt GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY qlike, model) AS rank FROM b""")
def leaderboard_es(spark: S, d: str) -> DataFrame:
    """Each model scored on each entity's own series, then its mean over the entities."""
    scores = r8(metrics.by_model(smoothed(spark, d), ["entity_id", "model"]), *_SCORES)
    board = scores.groupBy("model").agg(F.sum("n_obs").alias("n_obs"), *(F.round(F.avg(c), 7).alias(c) for c in _SCORES))
    return metrics.ranked(board).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH RECURSIVE {ES}, {_long('es', 'entity_id, model')} SELECT * FROM mt")
def metrics_by_model(spark: S, d: str) -> DataFrame:
    return r8(metrics.by_model(smoothed(spark, d), ["entity_id", "model"]), "qlike", "rmse", "mae", "hit_rate", "corr")


@query(f"WITH RECURSIVE {ES} SELECT entity_id, model, ts_utc, round(yhat, 8) AS yhat FROM es")
def es_recursion(spark: S, d: str) -> DataFrame:
    return r8(smoothed(spark, d).select("entity_id", "model", "ts_utc", "yhat"), "yhat")


_STES = DATA + """,
g AS (SELECT *, 1 / (1 + exp(-(-2 + 3 * abs(r) - 0.5::DOUBLE * r))) AS gate FROM data),
st AS (SELECT entity_id, step, ts_utc, r, y, gate, r * r AS yhat FROM g WHERE step = 0
  UNION ALL SELECT g.entity_id, g.step, g.ts_utc, g.r, g.y, g.gate, g.gate * g.r * g.r + (1 - g.gate) * st.yhat FROM st
  JOIN g ON g.entity_id = st.entity_id AND g.step = st.step + 1)"""


def _stes(spark: S, d: str) -> DataFrame:
    rows = dataset(spark, d).withColumn("gate", math.sigmoid(-2 + 3 * F.abs("r") - 0.5 * F.col("r")))
    return recursion.smooth_by(rows, "r", "gate")


@query(f"WITH RECURSIVE {_STES} SELECT entity_id, ts_utc, round(gate, 8) AS gate, round(yhat, 8) AS yhat FROM st")
def stes_recursion(spark: S, d: str) -> DataFrame:
    return r8(_stes(spark, d).select("entity_id", "ts_utc", "gate", "yhat"), "gate", "yhat")


@query(f"WITH RECURSIVE {_STES} SELECT entity_id, ts_utc, round(yhat, 8) AS yhat FROM st")
def volgru_stes_equivalent(spark: S, d: str) -> DataFrame:
    import numpy as np

    rows = dataset(spark, d)
    step = lambda g: {"yhat": recursion.gated(g["r"].to_numpy(float), np.column_stack([np.ones(len(g)), g["r"].abs(), g["r"]]), np.array([-2.0, 3.0, -0.5]), np.array([g["r"].iloc[0] ** 2]))}
    return r8(recursion.per_group(rows, ["entity_id"], ["ts_utc"], ["yhat"], step).select("entity_id", "ts_utc", "yhat"), "yhat")


@query(f"""WITH RECURSIVE {DATA}, i AS (SELECT entity_id, greatest(avg(r * r), 1e-8::DOUBLE) AS v0 FROM data WHERE step < 500 GROUP BY 1),
f AS (SELECT entity_id, step, ts_utc, v0 AS state, 0.1::DOUBLE * r * r + 0.9::DOUBLE * v0 AS yhat FROM data JOIN i USING (entity_id) WHERE step = 0
  UNION ALL SELECT d.entity_id, d.step, d.ts_utc, f.yhat, 0.1::DOUBLE * d.r * d.r + 0.9::DOUBLE * f.yhat FROM f
  JOIN data d ON d.entity_id = f.entity_id AND d.step = f.step + 1)
SELECT entity_id, ts_utc, round(state, 8) AS state, round(yhat, 8) AS yhat FROM f""")
def variance_filter(spark: S, d: str) -> DataFrame:
    return r8(recursion.filter_by(dataset(spark, d), "r", 0.1).select("entity_id", "ts_utc", "state", "yhat"), "state", "yhat")


@query(f"WITH {DATA} SELECT entity_id, round(greatest(avg(r * r), 1e-8::DOUBLE), 8) AS v0 FROM data WHERE step < 500 GROUP BY 1")
def initial_variance(spark: S, d: str) -> DataFrame:
    rows = dataset(spark, d).filter("step < 500")
    return rows.groupBy("entity_id").agg(F.round(F.greatest(F.avg(F.col("r") * F.col("r")), F.lit(1e-8)), 8).alias("v0"))


@query(f"""WITH RECURSIVE {DATA}, e AS (SELECT entity_id, step, ts_utc, r AS a, abs(r) AS b FROM data WHERE step = 0
  UNION ALL SELECT d.entity_id, d.step, d.ts_utc, pow(2::DOUBLE, -0.5::DOUBLE) * e.a + (1 - pow(2::DOUBLE, -0.5::DOUBLE)) * d.r, pow(2::DOUBLE,
  -0.5::DOUBLE) * e.b + (1 - pow(2::DOUBLE, -0.5::DOUBLE)) * abs(d.r) FROM e JOIN data d ON d.entity_id = e.entity_id AND d.step = e.step + 1)
SELECT entity_id, ts_utc, round(a, 8) AS "ewma.r.hl=2", round(b, 8) AS "ewma.abs_r.hl=2" FROM e""")
def ewma_bank(spark: S, d: str) -> DataFrame:
    rows = recursion.ewma_by(dataset(spark, d).withColumn("abs_r", F.abs("r")), ["r", "abs_r"], [2.0])
    return rows.select("entity_id", "ts_utc", *(F.round(F.col(f"`ewma.{c}.hl=2`"), 8).alias(f"ewma.{c}.hl=2") for c in ("r", "abs_r")))


_PG = """p AS (SELECT entity_id, step, ts_utc, y, r, greatest(y, 1e-12::DOUBLE) AS h FROM data WHERE step = 0
  UNION ALL SELECT d.entity_id, d.step, d.ts_utc, d.y, d.r, greatest((1 - {phi}) * {mu} + {phi} * ({g} * p.y + (1 - {g}) * p.h), 1e-12::DOUBLE)
  FROM p JOIN data d ON d.entity_id = p.entity_id AND d.step = p.step + 1)
SELECT entity_id, ts_utc, round(h, 8) AS h FROM p"""


@query(f"WITH RECURSIVE {DATA}, " + _PG.format(mu="0.5::DOUBLE", phi="0.95::DOUBLE", g="0.1::DOUBLE"))
def pgarch_path_const(spark: S, d: str) -> DataFrame:
    return r8(recursion.pgarch_by(dataset(spark, d), "y", 0.5, 0.95, 0.1).select("entity_id", "ts_utc", "h"), "h")


@query(f"WITH RECURSIVE {DATA}, " + _PG.format(mu="(1e-12::DOUBLE + ln(1 + exp(-1 + 0.2::DOUBLE * p.r)))", phi="(1e-4::DOUBLE + (1 - 2e-4::DOUBLE) / (1 + exp(-(2 - 0.1::DOUBLE * p.r))))", g="(1e-4::DOUBLE + (1 - 2e-4::DOUBLE) / (1 + exp(-(-2 + 0.3::DOUBLE * abs(p.r)))))"))
def pgarch_path_linear(spark: S, d: str) -> DataFrame:
    r = F.col("r")
    rows = dataset(spark, d).withColumns({"mu": math.mu_link(-1 + 0.2 * r), "phi": math.bounded_link(2 - 0.1 * r), "g": math.bounded_link(-2 + 0.3 * F.abs(r), math.G_RANGE)})
    return r8(recursion.pgarch_by(rows, "y", "mu", "phi", "g").select("entity_id", "ts_utc", "h"), "h")


@query(f"""WITH RECURSIVE {DATA}, p AS (SELECT entity_id, step, ts_utc, r, 1.0::DOUBLE AS h FROM data WHERE step = 0
  UNION ALL SELECT d.entity_id, d.step, d.ts_utc, d.r, 0.05::DOUBLE + 0.1::DOUBLE * p.r * p.r + 0.85::DOUBLE * p.h FROM p
  JOIN data d ON d.entity_id = p.entity_id AND d.step = p.step + 1)
SELECT entity_id, ts_utc, round(h, 8) AS h FROM p""")
def garch11_filter(spark: S, d: str) -> DataFrame:
    return r8(recursion.garch_by(dataset(spark, d), "r", 0.05, 0.1, 0.85, 1.0).select("entity_id", "ts_utc", "h"), "h")


@query(f"""WITH RECURSIVE {ES}, h AS (SELECT *, greatest(yhat, 1e-3::DOUBLE) AS h FROM es)
SELECT model, count(*) AS n, round(avg(ln(h) + y / h), 6) AS qlike_gaussian, round(avg(0.5::DOUBLE * (ln(h) + y / h)), 6) AS nll,
  round(median(abs(y - yhat)), 8) AS medae FROM h GROUP BY 1""")
def likelihoods(spark: S, d: str) -> DataFrame:
    h = math.clip(F.col("yhat"), 1e-3)
    return smoothed(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.round(metrics.qlike_gaussian(h=h), 6).alias("qlike_gaussian"), F.round(metrics.nll(F.col("yhat"), F.col("y"), 1e-3), 6).alias("nll"), F.round(metrics.medae(), 8).alias("medae"))


@query(f"""WITH RECURSIVE {ES}, t AS (SELECT model, pow(y - yhat, 2) AS se, row_number() OVER (PARTITION BY model
  ORDER BY pow(y - yhat, 2)) AS k, count(*) OVER (PARTITION BY model) AS n FROM es) SELECT model, round(sqrt(avg(se)), 8) AS trimmed_rmse FROM t
  WHERE k <= greatest(floor(0.95::DOUBLE * n), 1) GROUP BY 1""")
def trimmed_rmse(spark: S, d: str) -> DataFrame:
    return r8(metrics.trimmed_rmse(smoothed(spark, d), ["model"]), "trimmed_rmse")


@query(f"""WITH RECURSIVE {ES} SELECT model, round(quantile_cont(abs(y - yhat), 0.1), 8) AS q10, round(quantile_cont(abs(y - yhat), 0.5), 8) AS q50,
  round(quantile_cont(abs(y - yhat), 0.99), 8) AS q99 FROM es GROUP BY 1""")
def error_quantiles(spark: S, d: str) -> DataFrame:
    return r8(metrics.error_quantiles(smoothed(spark, d), ["model"], (0.1, 0.5, 0.99)), "q10", "q50", "q99")


@query(f"""WITH RECURSIVE {ES}, q AS (SELECT entity_id, quantile_cont(y, 1/3::DOUBLE) AS a, quantile_cont(y, 2/3::DOUBLE) AS b FROM es GROUP BY 1)
SELECT entity_id, model, round(sqrt(avg(pow(y - yhat, 2)) FILTER (y <= a)), 7) AS low_rmse, round(sqrt(avg(pow(y - yhat,
  2)) FILTER (y > a AND y <= b)), 7) AS mid_rmse, round(sqrt(avg(pow(y - yhat, 2)) FILTER (y > b)), 7) AS high_rmse,
round(median(abs(y - yhat)) FILTER (y <= a), 7) AS low_medae, round(median(abs(y - yhat)) FILTER (y > b), 7) AS high_medae FROM es
  JOIN q USING (entity_id) GROUP BY 1, 2""")
def regime_metrics(spark: S, d: str) -> DataFrame:
    return r8(metrics.regimes(smoothed(spark, d), ["entity_id", "model"]), "low_rmse", "mid_rmse", "high_rmse", "low_medae", "high_medae", digits=7)


@query("""SELECT event_type, round(avg(value), 7) AS mean, round(stddev_samp(value), 7) AS std, round(stddev_pop(value), 7) AS std_pop, count(value) AS n
  FROM events GROUP BY 1""")
def seed_mean_std(spark: S, d: str) -> DataFrame:
    return r8(metrics.seeds(table(spark, d, "events"), ["event_type"], "value"), "mean", "std", "std_pop", digits=7)


_GATES = f"""{_STES}, gf AS (SELECT *, lag(yhat) OVER k AS state FROM st WINDOW k AS (PARTITION BY entity_id ORDER BY ts_utc)),
gm AS (SELECT *, r * r - state AS move, CASE WHEN state IS NULL THEN NULL WHEN abs(r * r - state) < 1e-12::DOUBLE THEN 0.5::DOUBLE ELSE least(greatest((y - state) / (r * r - state), 0), 1) END AS best_gate, state + gate * (r * r - state) AS rebuilt, abs(r) AS abs_r FROM gf)"""


def _gates(spark: S, d: str) -> DataFrame:
    return diagnostics.gate_frame(_stes(spark, d), ["entity_id"]).withColumn("abs_r", F.abs("r"))


@query(f"""WITH RECURSIVE {_GATES} SELECT entity_id, ts_utc, round(state, 8) AS state, round(move, 8) AS move, round(best_gate, 7) AS best_gate FROM gm""")
def alpha_star(spark: S, d: str) -> DataFrame:
    rows = _gates(spark, d).select("entity_id", "ts_utc", "state", "move", "best_gate")
    return rows.withColumns({"state": F.round("state", 8), "move": F.round("move", 8), "best_gate": F.round("best_gate", 7)})


@query(f"""WITH RECURSIVE {_GATES} SELECT entity_id, round(avg(gate), 8) AS gate_mean, round(stddev_pop(gate), 8) AS gate_std,
  round(avg(CASE WHEN gate < 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 8) AS share_low,
  round(avg(CASE WHEN gate > 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 8) AS share_high, round(corr(gate, abs_r), 8) AS corr_size FROM gm GROUP BY 1""")
def gate_summary(spark: S, d: str) -> DataFrame:
    return r8(metrics.gate_summary(_gates(spark, d), ["entity_id"]), "gate_mean", "gate_std", "share_low", "share_high", "corr_size")


@query(f"""WITH RECURSIVE {_GATES}, ok AS (SELECT entity_id, move, CASE WHEN abs(move) > 1e-12::DOUBLE THEN gate END AS a,
  CASE WHEN abs(move) > 1e-12::DOUBLE THEN best_gate END AS b FROM gm WHERE state IS NOT NULL),
l AS (SELECT *, ln(least(greatest(a, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest(a, 1e-6::DOUBLE),
  1 - 1e-6::DOUBLE))) - ln(least(greatest(b, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest(b, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE))) AS gap
  FROM ok)
SELECT entity_id, round(avg(a), 7) AS gate_mean, round(stddev_pop(a), 7) AS gate_std, round(avg(b), 7) AS best_mean, round(stddev_pop(b),
  7) AS best_std, round(corr(a, b), 7) AS corr, round(sqrt(avg(gap * gap)), 6) AS logit_rmse, round(avg(abs(a - b)), 7) AS mae,
  round(avg(CASE WHEN abs(move) > 1e-12::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 7) AS share FROM l GROUP BY 1""")
def alpha_alignment(spark: S, d: str) -> DataFrame:
    out = metrics.gate_alignment(_gates(spark, d).filter("state is not null"), ["entity_id"])
    return r8(r8(out, "gate_mean", "gate_std", "best_mean", "best_std", "corr", "mae", "share", digits=7), "logit_rmse", digits=6)


@query(f"""WITH RECURSIVE {_GATES}, c AS (SELECT *, avg(gate) OVER (PARTITION BY entity_id) AS k FROM gm WHERE state IS NOT NULL),
e AS (SELECT entity_id, sqrt(avg(pow(y - (state + gate * move), 2))) AS o, sqrt(avg(pow(y - (state + k * move), 2))) AS c,
  sqrt(avg(pow(y - (state + best_gate * move), 2))) AS b, max(abs(rebuilt - yhat)) AS x FROM c GROUP BY 1)
SELECT entity_id, round(o, 8) AS rmse_own, round(c, 8) AS rmse_constant, round(b, 8) AS rmse_best, round((o - b) / (c - b + 1e-12::DOUBLE),
  6) AS gap_left, x <= 1e-8::DOUBLE AS rebuild_ok FROM e""")
def gate_reconstruction(spark: S, d: str) -> DataFrame:
    out = diagnostics.oracle_table(_gates(spark, d), ["entity_id"]).drop("rebuild_error")
    return r8(r8(out, "rmse_own", "rmse_constant", "rmse_best"), "gap_left", digits=6)


def _bins(value: str, src: str, q: int) -> str:
    edges = ", ".join(f"{i}/{q}::DOUBLE" for i in range(q + 1))
    return f"""e AS (SELECT list_distinct(quantile_cont({value}, [{edges}])) AS edges FROM {src} WHERE {value} IS NOT NULL),
b AS (SELECT x.*, greatest(len(list_filter(edges, lambda v: v < {value})) - 1, 0)::INT AS bin FROM {src} x, e WHERE {value} IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_GATES}, {_bins('best_gate', 'gm', 10)} SELECT bin, count(*) AS n, round(avg(best_gate), 7) AS mean_best, round(avg(gate),
  7) AS mean_gate FROM b GROUP BY 1""")
def gate_calibration(spark: S, d: str) -> DataFrame:
    return r8(diagnostics.calibration(_gates(spark, d)), "mean_best", "mean_gate", digits=7)


@query(f"""WITH RECURSIVE {_GATES}, gg AS (SELECT *, abs(gate - best_gate) AS gap FROM gm WHERE best_gate IS NOT NULL), {_bins('gap', 'gg', 5)}
  SELECT bin, count(*) AS n, round(sqrt(avg(pow(y - yhat, 2))), 7) AS rmse, round(avg(abs(y - yhat)), 7) AS mae, round(avg(gap), 7) AS mean_gap,
  round(avg(abs(move)), 7) AS mean_move FROM b GROUP BY 1""")
def mismatch_quintiles(spark: S, d: str) -> DataFrame:
    return r8(diagnostics.mismatch(_gates(spark, d)), "rmse", "mae", "mean_gap", "mean_move", digits=7)


@query(f"""WITH RECURSIVE {_GATES} SELECT entity_id, round(avg(CASE WHEN best_gate <= 0.01::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 8) AS at_0,
  round(avg(CASE WHEN best_gate >= 0.99::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 8) AS at_1 FROM gm WHERE best_gate IS NOT NULL GROUP BY 1""")
def boundary_mass(spark: S, d: str) -> DataFrame:
    return r8(diagnostics.boundary_mass(_gates(spark, d), ["entity_id"], "best_gate"), "at_0", "at_1")


@query(f"""WITH {RETS}, v AS (SELECT entity_id, ts_utc, abs(r) AS a FROM rets WHERE r IS NOT NULL), {_bins('a', 'v', 20)}
  SELECT bin, count(*) AS n, round(avg(a), 8) AS mean_a FROM b GROUP BY 1""")
def qcut_bins(spark: S, d: str) -> DataFrame:
    rows = returns(spark, d).dropna(subset=["r"]).select(F.abs("r").alias("a"))
    return windows.quantile_bins(rows, "a", 20).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("a"), 8).alias("mean_a"))


@query(f"""WITH {RETS}, n AS (SELECT entity_id, r, row_number() OVER (PARTITION BY entity_id ORDER BY ts_utc) AS k, count(*) OVER (PARTITION BY entity_id) AS c
  FROM rets WHERE r IS NOT NULL),
o AS (SELECT unnest(generate_series(-5, 5)) AS offset_)
SELECT offset_::INT AS "offset", round(avg(x.r), 8) AS mean, count(*) AS n FROM n JOIN o ON true
  JOIN n x ON x.entity_id = n.entity_id AND x.k = n.k + offset_ WHERE n.r > 0.5::DOUBLE AND n.k > 5 AND n.k <= n.c - 5 GROUP BY 1""")
def event_window_mean(spark: S, d: str) -> DataFrame:
    return r8(windows.event_path(returns(spark, d), "r", F.col("r") > 0.5, 5), "mean")


_WL = f"""{ES}, pv AS (SELECT entity_id, ts_utc, max(r) AS r, max(y) AS y, max(yhat) FILTER (model = 'es_slow') AS a, max(yhat) FILTER (model = 'es_fast') AS f
  FROM es GROUP BY 1, 2),
ls AS (SELECT *, pow(y - a, 2) AS loss_a, pow(y - f, 2) AS loss_b, pow(y - a, 2) - pow(y - f, 2) AS d, r * r - lag(f) OVER (PARTITION BY entity_id
  ORDER BY ts_utc) AS u FROM pv)"""


def _losses(spark: S, d: str) -> DataFrame:
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(m)
    rows = smoothed(spark, d).groupBy("entity_id", "ts_utc").agg(F.max("r").alias("r"), F.max("y").alias("y"), of("es_slow"), of("es_fast"))
    gap = lambda c: (F.col("y") - F.col(c)) * (F.col("y") - F.col(c))
    rows = rows.withColumns({"loss_a": gap("es_slow"), "loss_b": gap("es_fast")})
    return rows.withColumn("u", F.col("r") * F.col("r") - F.lag("es_fast").over(windows.by_entity())).withColumn("d", F.col("loss_a") - F.col("loss_b"))


@query(f"""WITH RECURSIVE {_WL}, q AS (SELECT entity_id, quantile_cont(d, 0.05) AS lo, quantile_cont(d, 0.95) AS hi FROM ls GROUP BY 1),
w AS (SELECT ls.*, CASE WHEN d >= hi THEN 'win' WHEN d <= lo THEN 'lose' END AS event FROM ls JOIN q USING (entity_id))
SELECT event, count(*) AS n, round(avg(d), 6) AS mean_d, round(avg(loss_a), 6) AS mean_loss_a, round(avg(loss_b), 6) AS mean_loss_b, round(avg(u),
  6) AS mean_u, round(avg(CASE WHEN u > 0 THEN 1.0::DOUBLE WHEN u IS NOT NULL THEN 0 END), 8) AS share_u FROM w WHERE event IS NOT NULL GROUP BY 1""")
def win_lose_summary(spark: S, d: str) -> DataFrame:
    events = diagnostics.win_lose(_losses(spark, d), F.col("d"))
    out = diagnostics.event_summary(events, ["d", "loss_a", "loss_b", "u"], ["u"])
    return r8(r8(out, "mean_d", "mean_loss_a", "mean_loss_b", "mean_u", digits=6), "share_u")


_LRV = """c AS (SELECT entity_id, ts_utc, d - avg(d) OVER (PARTITION BY entity_id) AS c, avg(d) OVER (PARTITION BY entity_id) AS mean,
  count(*) OVER (PARTITION BY entity_id) AS n, row_number() OVER (PARTITION BY entity_id ORDER BY ts_utc) AS k FROM ls),
b AS (SELECT DISTINCT entity_id, mean, n, floor(4 * pow(n / 100, 2::DOUBLE / 9))::INT AS lags FROM c),
bl AS (SELECT *, unnest(generate_series(0, lags)) AS l FROM b),
g AS (SELECT x.entity_id, l, lags, sum(x.c * z.c) / max(bl.n) AS gamma FROM bl JOIN c x ON x.entity_id = bl.entity_id
  JOIN c z ON z.entity_id = x.entity_id AND z.k = x.k + bl.l GROUP BY 1, 2, 3),
v AS (SELECT entity_id, sum(CASE WHEN l = 0 THEN gamma ELSE 2 * (1 - l / (lags + 1.0::DOUBLE)) * gamma END) AS lrv FROM g GROUP BY 1)"""


@query(f"WITH RECURSIVE {_WL}, {_LRV} SELECT entity_id, n, round(mean, 6) AS mean, lags, round(lrv, 4) AS lrv FROM b JOIN v USING (entity_id)")
def newey_west(spark: S, d: str) -> DataFrame:
    return r8(r8(stats.long_run_variance(_losses(spark, d), "d", ["entity_id"]), "mean", digits=6), "lrv", digits=4)


@query(f"""WITH RECURSIVE {_WL}, {_LRV} SELECT entity_id, n, round(mean, 6) AS mean_d, lags, round(mean / sqrt(lrv / n), 6) AS dm FROM b JOIN v USING (entity_id)""")
def diebold_mariano_stat(spark: S, d: str) -> DataFrame:
    return r8(stats.diebold_mariano(_losses(spark, d), ["entity_id"]), "mean_d", "dm", digits=6)


@query()
def diebold_mariano_p(spark: S, d: str) -> DataFrame:
    return r8(stats.with_p_value(stats.diebold_mariano(_losses(spark, d), ["entity_id"])), "mean_d", "dm", "p", digits=6)


def _mz(y: str, x: str) -> str:
    return f"""SELECT model, count(*) AS n, round(regr_intercept({y}, {x}), 6) AS alpha, round(regr_slope({y}, {x}), 6) AS beta,
round(regr_intercept({y}, {x}) / sqrt(regr_syy({y}, {x}) * (1 - regr_r2({y}, {x})) / (count(*) - 2) * (1.0::DOUBLE / count(*) + pow(avg({x}),
  2) / regr_sxx({y}, {x}))), 5) AS t_alpha,
round(regr_slope({y}, {x}) / sqrt(regr_syy({y}, {x}) * (1 - regr_r2({y}, {x})) / (count(*) - 2) / regr_sxx({y}, {x})), 5) AS t_beta,
  round(regr_r2({y}, {x}), 7) AS r2"""


def _mz_round(df: DataFrame) -> DataFrame:
    return r8(r8(r8(df, "alpha", "beta", digits=6), "t_alpha", "t_beta", digits=5), "r2", digits=7)


@query(f"WITH RECURSIVE {ES} {_mz('y', 'yhat')} FROM es GROUP BY 1")
def mincer_zarnowitz(spark: S, d: str) -> DataFrame:
    return _mz_round(stats.mincer_zarnowitz(smoothed(spark, d), ["model"]))


@query(f"WITH RECURSIVE {ES} {_mz('ln(y)', 'ln(yhat)')} FROM es WHERE y > 0 AND yhat > 0 GROUP BY 1")
def mincer_zarnowitz_log(spark: S, d: str) -> DataFrame:
    return _mz_round(stats.mincer_zarnowitz(smoothed(spark, d), ["model"], log=True))


@query(f"""WITH RECURSIVE {ES}, l AS (SELECT model, regr_slope(y, yhat) AS b, regr_intercept(y, yhat) AS a FROM es GROUP BY 1)
  SELECT entity_id, model, ts_utc, round(a + b * yhat, 6) AS fitted, round(y - a - b * yhat, 6) AS resid FROM es JOIN l USING (model)""")
def mz_residuals(spark: S, d: str) -> DataFrame:
    return r8(stats.fitted(smoothed(spark, d), ["model"]).select("entity_id", "model", "ts_utc", "fitted", "resid"), "fitted", "resid", digits=6)


@query(f"""WITH RECURSIVE {ES}, k AS (SELECT model, rank() OVER (PARTITION BY model
  ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY model
  ORDER BY yhat) + (count(*) OVER (PARTITION BY model, yhat) - 1) / 2.0::DOUBLE AS b FROM es) SELECT model, round(corr(a, b), 7) AS spearman FROM k
  GROUP BY 1""")
def spearman(spark: S, d: str) -> DataFrame:
    return r8(stats.spearman(smoothed(spark, d), ["model"], "y", "yhat"), "spearman", digits=7)


@query("""WITH c AS (SELECT event_type, median(value) AS c FROM events GROUP BY 1)
  SELECT event_type, round(greatest(1.4826::DOUBLE * median(abs(value - c)), 1e-12::DOUBLE), 8) AS sigma FROM events JOIN c USING (event_type)
  GROUP BY 1""")
def mad_sigma(spark: S, d: str) -> DataFrame:
    return r8(metrics.mad_sigma(table(spark, d, "events"), "value", ["event_type"]), "sigma")


@query("""SELECT user_id, round(sum((1 + event_id % 3) * value) / sum(1 + event_id % 3), 7) AS a,
  round(sum((1 + event_id % 3) * value * value) / sum(1 + event_id % 3), 5) AS b FROM events GROUP BY 1""")
def blend_scores(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("value").alias("a"), (F.col("value") * F.col("value")).alias("b"), (1 + F.col("event_id") % 3).alias("weight"))
    return r8(r8(metrics.blend(rows, ["user_id"], ["a", "b"]), "a", digits=7), "b", digits=5)


@query(f"WITH RECURSIVE {ES} SELECT entity_id, ts_utc, round(avg(yhat), 8) AS yhat_mean FROM es WHERE model <> 'es_mid' GROUP BY 1, 2")
def ensemble_mean(spark: S, d: str) -> DataFrame:
    return r8(metrics.ensemble(smoothed(spark, d).filter("model <> 'es_mid'"), ["entity_id", "ts_utc"]), "yhat_mean")


@query(f"""WITH RECURSIVE {ES} SELECT entity_id, ts_utc, round(max(yhat) FILTER (model = 'es_slow'), 8) AS es_slow, round(max(yhat) FILTER (model = 'es_mid'),
  8) AS es_mid, round(max(yhat) FILTER (model = 'es_fast'), 8) AS es_fast FROM es GROUP BY 1, 2""")
def wide_runs(spark: S, d: str) -> DataFrame:
    wide = smoothed(spark, d).groupBy("entity_id", "ts_utc").pivot("model", ["es_slow", "es_mid", "es_fast"]).agg(F.first("yhat"))
    return r8(wide, "es_slow", "es_mid", "es_fast")


@query(f"""WITH RECURSIVE {ES}, k AS (SELECT model, avg(pow(y - yhat, 2)) AS e FROM es GROUP BY 1) SELECT arg_min(model, e) AS best, round(min(e), 7) AS mse
  FROM k""")
def best_candidate(spark: S, d: str) -> DataFrame:
    scores = smoothed(spark, d).groupBy("model").agg(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)).alias("e"))
    return scores.agg(F.min_by("model", "e").alias("best"), F.round(F.min("e"), 7).alias("mse"))


@query(f"WITH {RETS} SELECT entity_id, ts_utc, round(r, 8) AS r FROM (SELECT * FROM rets WHERE r IS NOT NULL ORDER BY abs(r) DESC, ts_utc LIMIT 25)")
def topk_abs(spark: S, d: str) -> DataFrame:
    return r8(diagnostics.top_by_size(returns(spark, d).dropna(subset=["r"]), "r", 25, "ts_utc").select("entity_id", "ts_utc", "r"), "r")


@query(f"""WITH RECURSIVE {ES}, w AS (SELECT *, floor(step / 400)::BIGINT AS window_no, greatest(y, 1e-8::DOUBLE) / greatest(yhat, 1e-8::DOUBLE) AS q FROM es),
k AS (SELECT entity_id, window_no, model, round(avg(q - ln(q) - 1), 7) AS qlike FROM w GROUP BY 1, 2, 3)
SELECT entity_id, window_no, model, qlike, row_number() OVER (PARTITION BY entity_id, window_no ORDER BY qlike, model) AS rank FROM k""")
def window_rank(spark: S, d: str) -> DataFrame:
    rows = smoothed(spark, d).withColumn("window_no", F.floor(F.col("step") / 400))
    return metrics.ranked_within(r8(metrics.score_by(rows, ["entity_id", "window_no", "model"], metrics.qlike(), "qlike"), "qlike", digits=7), ["entity_id", "window_no"])


_FA = """f AS (SELECT model || ':0001' AS model_id, entity_id AS ticker, ts_utc AS target_utc, 1 AS horizon, yhat
  FROM es), a AS (SELECT entity_id AS ticker, ts_utc AS target_utc, 1 AS horizon, y AS y_actual FROM data)"""


def _stored(spark: S, d: str, ticker: str | None = None) -> tuple[DataFrame, DataFrame]:
    f = smoothed(spark, d, ticker).select(F.concat("model", F.lit(":0001")).alias("model_id"), F.col("entity_id").alias("ticker"), F.col("ts_utc").alias("asof_utc"), F.col("ts_utc").alias("target_utc"), F.lit(1).alias("horizon"), "yhat")
    return f, dataset(spark, d).select(F.col("entity_id").alias("ticker"), F.col("ts_utc").alias("target_utc"), F.lit(1).alias("horizon"), "y")


@query(f"""WITH RECURSIVE {ES}, {_FA} SELECT f.model_id, f.ticker, f.target_utc, f.horizon, round(yhat, 8) AS yhat, round(y_actual, 8) AS y_actual FROM f
  JOIN a USING (ticker, target_utc, horizon) WHERE ticker = 'A' AND f.target_utc BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1997-01-01'""")
def forecast_actual_join(spark: S, d: str) -> DataFrame:
    return r8(store.forecasts_with_actuals(*_stored(spark, d, "A"), "A", "1994-01-01", "1997-01-01").drop("asof_utc"), "yhat", "y_actual")


@query(f"""WITH RECURSIVE {ES}, {_FA}, j AS (SELECT split_part(f.model_id, ':', 1) AS model, model_id, target_utc AS ts_utc, y_actual AS y, yhat FROM f
  JOIN a USING (ticker, target_utc, horizon)
  WHERE ticker = 'N' AND target_utc BETWEEN TIMESTAMP '1998-01-01' - INTERVAL 378 DAY AND TIMESTAMP '1998-01-01'),
t AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY model ORDER BY ts_utc DESC, model_id DESC) <= 252), {_long('t', 'model')}
  SELECT *, row_number() OVER (ORDER BY qlike, model)::INT AS rank FROM mt""")
def leaderboard(spark: S, d: str) -> DataFrame:
    joined = store.forecasts_with_actuals(*_stored(spark, d, "N"), "N", "1996-12-19", "1998-01-01")
    return r8(store.leaderboard(joined), "qlike", "rmse", "mae", "hit_rate", "corr")


@query("""WITH o AS (SELECT user_id, event_id, ts, value, user_id::VARCHAR || '-' || (event_id % 50)::VARCHAR AS k FROM events), old AS (SELECT * FROM o
  WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) = 1),
new AS (SELECT * FROM o WHERE event_id % 2 = 1 OR event_id % 7 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) = 1)
SELECT k, event_id, value FROM new UNION ALL SELECT k, event_id, value FROM old WHERE k NOT IN (SELECT k FROM new)""")
def store_upsert(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 50).cast("string")).alias("k"), "event_id", "ts", "value")
    old = panel.keep_last(rows.filter("event_id % 2 = 0"), ["k"], "ts", "event_id")
    return store.merge(old, rows.filter("event_id % 2 = 1 or event_id % 7 = 0"), "k", "ts", "event_id").drop("ts")


_MODELS = "mo AS (SELECT o_orderpriority AS model_type, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey))::INT AS version, o_orderdate AS created_utc, o_orderdate AS trained_end, o_orderpriority || ':' || o_orderkey::VARCHAR AS model_id FROM orders)"


def _models(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    number = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    return rows.select(F.col("o_orderpriority").alias("model_type"), number.alias("version"), F.col("o_orderdate").alias("created_utc"), F.col("o_orderdate").alias("trained_end"), F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("model_id"))


@query(f"""WITH {_MODELS} SELECT model_type, model_id, version, trained_end FROM mo QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY version DESC) = 1""")
def latest_model(spark: S, d: str) -> DataFrame:
    return store.latest(_models(spark, d)).select("model_type", "model_id", "version", "trained_end")


@query(f"WITH {_MODELS} SELECT model_type, coalesce(max(version), 0) + 1 AS next_version FROM mo GROUP BY 1")
def next_version(spark: S, d: str) -> DataFrame:
    return store.next_version(_models(spark, d))


@query(f"""WITH {_MODELS}, l AS (SELECT * FROM mo QUALIFY row_number() OVER (PARTITION BY model_type
  ORDER BY version DESC) = 1), n AS (SELECT DISTINCT model_type FROM mo UNION ALL SELECT 'none')
SELECT model_type, model_id, coalesce(DATE '1998-01-01' - trained_end::DATE >= 30, true) AS refit FROM n LEFT JOIN l USING (model_type)""")
def refit_decision(spark: S, d: str) -> DataFrame:
    models = _models(spark, d)
    names = models.select("model_type").distinct().unionByName(spark.createDataFrame([("none",)], "model_type string"))
    return store.refit_due(models, names, F.lit("1998-01-01").cast("date"))


def _folded(spark: S, d: str, make) -> DataFrame:
    """What each entity has in each part of each of the folds that ``make`` makes of the longest series' length."""
    rows = dataset(spark, d)
    made = make(rows.agg(F.max("step")).first()[0] + 1)
    out = folds.assign(rows, made).groupBy("fold", "entity_id", "part").agg(F.count("*").alias("n"), F.min("ts_utc").alias("first"), F.avg("y").alias("mean_y"))
    return r8(out, "mean_y", digits=6)


_FOLDED = f"""{DATA}, n AS (SELECT max(step) + 1 AS n FROM data), f AS ({{}}) SELECT fold, entity_id, CASE WHEN step < train_to THEN 'train' ELSE 'val' END AS part,
  count(*) AS n, min(ts_utc) AS first, round(avg(y), 6) AS mean_y FROM data JOIN f ON step >= train_from AND step < val_to GROUP BY 1, 2, 3"""


@query("WITH " + _FOLDED.format("SELECT unnest(range(0, greatest((n - 252) // 100 + 1, 0))) AS fold, fold * 100 AS train_from, 200 + fold * 100 AS train_to, 252 + fold * 100 AS val_to FROM n"))
def walk_forward_folds(spark: S, d: str) -> DataFrame:
    """Rolling folds of 200 rows and the 52 behind them, a new one every 100 rows."""
    return _folded(spark, d, lambda n: folds.walk_forward(spark, n, "rolling", 200, 52, 100))


@query("WITH " + _FOLDED.format("SELECT unnest(range(0, 4)) AS fold, 0 AS train_from, n - (4 - fold) * (n // 5) AS train_to, n - (3 - fold) * (n // 5) AS val_to FROM n"))
def expanding_blocks(spark: S, d: str) -> DataFrame:
    return _folded(spark, d, lambda n: folds.expanding_blocks(spark, n, 4))


@query("WITH " + _FOLDED.format("SELECT * FROM (VALUES (0, 100, 400, 500), (1, 300, 600, 700), (2, 700, 1000, 1100)) t(fold, train_from, train_to, val_to)"))
def rolling_windows(spark: S, d: str) -> DataFrame:
    """Windows of 300 rows, each scored on the 100 behind it, that begin where a study says."""
    return _folded(spark, d, lambda n: folds.fixed_starts(spark, (400, 600, 1000), 300, 100))


@query(f"""WITH RECURSIVE {ES}, n AS (SELECT entity_id, max(step) + 1 AS n FROM es
  GROUP BY 1), k AS (SELECT entity_id, unnest(generate_series(0, greatest((n - 750) // 250, -1))) AS fold FROM n)
SELECT fold, model, round(avg(pow(y - yhat, 2)), 6) AS mse, count(*) AS n FROM es
  JOIN k ON es.entity_id = k.entity_id AND step >= 500 + 250 * fold AND step < 750 + 250 * fold GROUP BY 1, 2""")
def fold_metrics(spark: S, d: str) -> DataFrame:
    """Every entity's own folds, as many as its rows have room for."""
    rows = folds.validation_rows(smoothed(spark, d), 500, 250, ["entity_id", "model"])
    return rows.groupBy("fold", "model").agg(F.round(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)), 6).alias("mse"), F.count("*").alias("n"))


GRID = [k / 25 for k in range(1, 20)]


@query(f"""WITH RECURSIVE {DATA}, gates AS (SELECT unnest({GRID})::DOUBLE AS gate),
es AS (SELECT entity_id, gate, step, r, y, r * r AS yhat FROM data, gates WHERE step = 0
  UNION ALL SELECT d.entity_id, e.gate, d.step, d.r, d.y, e.gate * d.r * d.r + (1 - e.gate) * e.yhat FROM es e
  JOIN data d ON d.entity_id = e.entity_id AND d.step = e.step + 1),
k AS (SELECT entity_id, gate, avg(pow(y - yhat, 2)) AS mse FROM es GROUP BY 1, 2)
SELECT entity_id, arg_min(gate, (round(mse, 9), gate)) AS gate, round(min(mse), 6) AS mse FROM k GROUP BY 1""")
def es_grid_search(spark: S, d: str) -> DataFrame:
    """The constant gate of least squared error among a grid, each (entity, gate) a group of its own."""
    fan = dataset(spark, d).withColumn("gate", F.explode(F.array(*(F.lit(g) for g in GRID))))
    scores = recursion.smooth_by(fan, "r", "gate", by=("entity_id", "gate")).groupBy("entity_id", "gate").agg(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)).alias("mse"))
    return scores.groupBy("entity_id").agg(F.min(F.struct(F.round("mse", 9).alias("m"), "gate"))["gate"].alias("gate"), F.round(F.min("mse"), 6).alias("mse"))


@query(f"""WITH {RETS}, p AS (SELECT entity_id, ts_utc, list(r) OVER (PARTITION BY entity_id ORDER BY ts_utc ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS p
  FROM rets WHERE r IS NOT NULL)
SELECT entity_id, ts_utc, round(p[6] - p[1], 8) AS s1, round(pow(p[6] - p[1], 2) / 2, 8) AS s11 FROM p WHERE len(p) = 6""")
def signature_depth2(spark: S, d: str) -> DataFrame:
    rows = returns(spark, d).dropna(subset=["r"]).withColumn("p", windows.path("r", 5)).dropna(subset=["p"])
    return rows.select("entity_id", "ts_utc", *(F.round(c, 8).alias(n) for n, c in signature.depth2(F.col("p")).items()))


@query(f"""WITH {RETS}, p AS (SELECT entity_id, ts_utc, list(r) OVER (PARTITION BY entity_id ORDER BY ts_utc ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS p
  FROM rets WHERE r IS NOT NULL)
SELECT entity_id, ts_utc, 1.0::DOUBLE AS t1, round(p[4] - p[1], 8) AS t2, 1.0::DOUBLE AS t3,
  round(((p[2] - p[1]) + (p[3] - p[2]) * 3 + (p[4] - p[3]) * 5) / 3, 8) AS t4,
  round(2 * (p[4] - p[1]) - ((p[2] - p[1]) + (p[3] - p[2]) * 3 + (p[4] - p[3]) * 5) / 3, 8) AS t5, round(pow(p[4] - p[1], 2), 8) AS t6
  FROM p WHERE len(p) = 4""")
def signature_with_time(spark: S, d: str) -> DataFrame:
    rows = signature.features(returns(spark, d).dropna(subset=["r"]), ["r"], 3, 2, ("addtime",)).filter(F.col("`sig.term=0`").isNotNull())
    return rows.select("entity_id", "ts_utc", *(F.round(F.col(f"`sig.term={j}`"), 8).alias(f"t{j + 1}") for j in range(6)))


@query(f"""WITH {RETS} SELECT entity_id, ts_utc, round(-2 + 3 * abs(r) - 0.5::DOUBLE * r, 8) AS score, round(3 * abs(r), 8) AS c_abs_r, round(-0.5::DOUBLE * r,
  8) AS c_r FROM rets WHERE r IS NOT NULL""")
def score_contributions(spark: S, d: str) -> DataFrame:
    rows = returns(spark, d).dropna(subset=["r"]).withColumns({"const": F.lit(1.0), "abs_r": F.abs("r")})
    out = diagnostics.contributions(rows, {"const": -2.0, "abs_r": 3.0, "r": -0.5})
    return r8(out.select("entity_id", "ts_utc", "score", "c_abs_r", "c_r"), "score", "c_abs_r", "c_r")


@query(f"""WITH RECURSIVE {_STES} SELECT entity_id, round(avg(greatest(least(gate, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) * ln(greatest(least(gate, 1 - 1e-6::DOUBLE),
  1e-6::DOUBLE)) + (1 - greatest(least(gate, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE)) * ln(1 - greatest(least(gate, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE))),
  8) AS entropy FROM st GROUP BY 1""")
def gate_entropy(spark: S, d: str) -> DataFrame:
    z = math.clip(F.col("gate"), 1e-6, 1 - 1e-6)
    return _stes(spark, d).groupBy("entity_id").agg(F.round(F.avg(z * F.log(z) + (1 - z) * F.log(1 - z)), 8).alias("entropy"))


@query("SELECT event_type AS model, round(arg_max(value, row(ts, event_id)), 8) AS yhat FROM events GROUP BY 1")
def latest_prediction(spark: S, d: str) -> DataFrame:
    rows = ticks(spark, d).select(F.col("entity_id").alias("model"), "ts", "event_id", F.col("price").alias("yhat"))
    return r8(panel.keep_last(rows, ["model"], "ts", "event_id").select("model", "yhat"), "yhat")





@query(f"""WITH RECURSIVE {DATA}, m AS (SELECT entity_id, max(step) AS last FROM data GROUP BY 1), x AS (SELECT data.*, 0.9::DOUBLE / (1 + y) AS rho, last
  FROM data JOIN m USING (entity_id)),
a AS (SELECT entity_id, step, ts_utc, r AS pull, 1.0::DOUBLE AS weight FROM x WHERE step = last
  UNION ALL SELECT x.entity_id, x.step, x.ts_utc, x.r + x.rho * a.pull, 1 + x.rho * x.rho * a.weight FROM a
  JOIN x ON x.entity_id = a.entity_id AND x.step = a.step - 1)
SELECT entity_id, ts_utc, round(pull, 8) AS pull, round(weight, 8) AS weight FROM a""")
def backward_adjoint(spark: S, d: str) -> DataFrame:
    rows = dataset(spark, d).withColumn("rho", 0.9 / (1 + F.col("y")))
    return r8(recursion.adjoint_by(rows, "r", "rho").select("entity_id", "ts_utc", "pull", "weight"), "pull", "weight")


@query("SELECT round(sum(n), 6) AS penalty FROM (SELECT sqrt(sum(value * value) + 1e-12::DOUBLE) AS n FROM events GROUP BY event_type)")
def group_penalty(spark: S, d: str) -> DataFrame:
    return r8(metrics.group_penalty(table(spark, d, "events"), "event_type", "value"), "penalty", digits=6)


@query(f"WITH RECURSIVE {ES} SELECT entity_id, model, round(y - yhat, 8) AS error FROM es WHERE ts_utc::DATE = DATE '1996-02-01'")
def errors_for_date(spark: S, d: str) -> DataFrame:
    return r8(metrics.errors_on(smoothed(spark, d), "1996-02-01").select("entity_id", "model", "error"), "error")


@query(f"WITH {DATA} SELECT ts_utc, round(r, 8) AS r, step FROM data WHERE entity_id = 'A'")
def cross_section(spark: S, d: str) -> DataFrame:
    return r8(panel.cross_section(dataset(spark, d), "A").select("ts_utc", "r", "step"), "r")


@query(f"WITH {_MODELS} SELECT model_type, version, model_id FROM mo WHERE version IN (1, 3)")
def version_report(spark: S, d: str) -> DataFrame:
    return store.version_report(_models(spark, d), 1, 3)


@query(f"""WITH RECURSIVE {ES} SELECT entity_id AS ticker, model, round(yhat, 8) AS yhat, round(y, 8) AS y_actual, round(y - yhat, 8) AS error FROM es
  WHERE ts_utc::DATE = DATE '1996-02-01'""")
def report_for_date(spark: S, d: str) -> DataFrame:
    f, a = _stored(spark, d)
    return r8(store.report(f, a, "1996-02-01"), "yhat", "y_actual", "error")


@query(f"""WITH RECURSIVE {_GATES}, c AS (SELECT *, avg(gate) OVER (PARTITION BY entity_id) AS k FROM gm WHERE state IS NOT NULL),
e AS (SELECT entity_id, sqrt(avg(pow(y - (state + gate * move), 2))) AS o, sqrt(avg(pow(y - (state + k * move), 2))) AS c,
  sqrt(avg(pow(y - (state + best_gate * move), 2))) AS b FROM c GROUP BY 1),
q AS (SELECT entity_id, rank() OVER (PARTITION BY entity_id ORDER BY gate) + (count(*) OVER (PARTITION BY entity_id, gate) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY entity_id ORDER BY best_gate) + (count(*) OVER (PARTITION BY entity_id, best_gate) - 1) / 2.0::DOUBLE AS b FROM c),
s AS (SELECT entity_id, corr(a, b) AS spearman FROM q GROUP BY 1)
SELECT entity_id, round(c - b, 7) AS gain_best, round(c - o, 7) AS gain_own, round((o - b) / (c - b + 1e-12::DOUBLE), 6) AS gap_left, round(spearman,
  6) AS spearman FROM e JOIN s USING (entity_id)""")
def gate_report(spark: S, d: str) -> DataFrame:
    out = diagnostics.gate_report(_gates(spark, d), ["entity_id"]).select("entity_id", "gain_best", "gain_own", "gap_left", "spearman")
    return r8(r8(out, "gain_best", "gain_own", digits=7), "gap_left", "spearman", digits=6)


_LOGIT = "ln(least(greatest({0}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest({0}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)))"


@query(f"""WITH RECURSIVE {_GATES} SELECT entity_id, ts_utc, abs(move) > 1e-12::DOUBLE AS told, round({_LOGIT.format('gate')}, 6) AS logit_gate,
  round({_LOGIT.format('best_gate')}, 6) AS logit_best, round(y - yhat, 8) AS error FROM gm WHERE state IS NOT NULL""")
def gate_diagnostics(spark: S, d: str) -> DataFrame:
    out = diagnostics.gate_diagnostics(_gates(spark, d).filter("state is not null")).select("entity_id", "ts_utc", "told", "logit_gate", "logit_best", "error")
    return r8(r8(out, "logit_gate", "logit_best", digits=6), "error")


_COEF = " UNION ALL ".join(f"SELECT entity_id, '{n}' AS feature, round(regr_slope(y, {x}), 6) AS value FROM data GROUP BY 1" for n, x in (("r", "r"), ("abs_r", "abs(r)"), ("sq_r", "r * r")))


@query(f"""WITH {DATA}, c AS ({_COEF}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY abs(value) DESC, feature)::INT AS rank
  FROM c) WHERE rank <= 2""")
def ranked_slopes(spark: S, d: str) -> DataFrame:
    """Each entity's two largest slopes of the target on one feature."""
    r = F.col("r")
    long = dataset(spark, d).select("entity_id", "y", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), x.alias("x")) for n, x in (("r", r), ("abs_r", F.abs(r)), ("sq_r", r * r))))).alias("f")).select("entity_id", "y", "f.*")
    slopes = r8(long.groupBy("entity_id", "feature").agg(F.regr_slope("y", "x").alias("value")), "value", digits=6)
    return diagnostics.ranked_coefficients(slopes, ["entity_id"], k=2)


_CAND = f"""{ES}, w AS (SELECT *, floor(step / 400)::BIGINT AS window_no FROM es),
pv AS (SELECT entity_id AS e, window_no, ts_utc, max(y) AS y, max(yhat) FILTER (model = 'es_fast') AS c, max(yhat) FILTER (model = 'es_slow') AS s,
  max(yhat) FILTER (model = 'es_mid') AS m FROM w GROUP BY 1, 2, 3),
ql AS (SELECT e, window_no, count(*) AS n, sqrt(avg(pow(y - c, 2))) AS rmse,
  {", ".join(f"avg(greatest(y, 1e-8::DOUBLE) / greatest({x}, 1e-8::DOUBLE) - ln(greatest(y, 1e-8::DOUBLE) / greatest({x}, 1e-8::DOUBLE)) - 1) AS q{x}" for x in "csm")} FROM pv GROUP BY 1, 2),
ls AS (SELECT e || '|' || window_no || '|s' AS entity_id, ts_utc, pow(y - c, 2) - pow(y - s, 2) AS d FROM pv UNION ALL
  SELECT e || '|' || window_no || '|m', ts_utc, pow(y - c, 2) - pow(y - m, 2) FROM pv), {_LRV},
dm AS (SELECT entity_id, CASE WHEN lrv > 0 THEN mean / sqrt(lrv / n) END AS dm FROM b JOIN v USING (entity_id))
SELECT e AS entity_id, window_no, n, round(qc, 6) AS qlike, round(rmse, 6) AS rmse, (1 + (qs < qc)::INT + (qm < qc)::INT)::INT AS rank,
  round(qs - qc, 6) AS gain_vs_es_slow, round(qm - qc, 6) AS gain_vs_es_mid,
  round(x.dm, 5) AS dm_vs_es_slow, round(z.dm, 5) AS dm_vs_es_mid FROM ql JOIN dm x ON x.entity_id = e || '|' || window_no || '|s'
  JOIN dm z ON z.entity_id = e || '|' || window_no || '|m'"""


@query(f"WITH RECURSIVE {_CAND}")
def candidate_rows(spark: S, d: str) -> DataFrame:
    rows = smoothed(spark, d).withColumn("window_no", F.floor(F.col("step") / 400))
    out = validation.candidate_rows(rows, "es_fast", ["es_slow", "es_mid"], ["entity_id", "window_no"], p_values=False).drop("qlike_es_slow", "qlike_es_mid")
    return r8(r8(out, "qlike", "rmse", "gain_vs_es_slow", "gain_vs_es_mid", digits=6), "dm_vs_es_slow", "dm_vs_es_mid", digits=5)


_CMP = f"""{_WL}, q AS (SELECT entity_id, quantile_cont(d, 0.05) AS lo, quantile_cont(d, 0.95) AS hi FROM ls GROUP BY 1),
ev AS (SELECT ls.*, CASE WHEN d >= hi THEN 'win' WHEN d <= lo THEN 'lose' END AS event, row_number() OVER (PARTITION BY entity_id
  ORDER BY ts_utc) AS k, count(*) OVER (PARTITION BY entity_id) AS c FROM ls JOIN q USING (entity_id)),
o AS (SELECT unnest(generate_series(-3, 3)) AS offset_)
SELECT n.event, offset_::INT AS "offset", round(avg(x.u), 6) AS mean, count(x.u) AS n FROM ev n JOIN o ON true
  JOIN ev x ON x.entity_id = n.entity_id AND x.k = n.k + offset_ WHERE n.event IS NOT NULL AND n.k > 3 AND n.k <= n.c - 3 GROUP BY 1, 2"""


@query(f"WITH RECURSIVE {_CMP}")
def comparison_path(spark: S, d: str) -> DataFrame:
    """The mean innovation around the days on which one of two models did much better."""
    return r8(validation.comparison(smoothed(spark, d), "es_slow", "es_fast", window=3)["path"], "mean", digits=6)


def _moves(paths: list[str], n: int, log: bool = False) -> list[str]:
    """Level 1 and twice level 2 of the signature of channels that are lists of n values, or level 1 and the areas of its logarithm."""
    one = [f"({p}[{n}] - {p}[1])" for p in paths]
    area = "list_sum(list_transform(generate_series(2, {n}), lambda k: ({i}[k - 1] - {i}[1]) * ({j}[k] - {j}[k - 1]) + 0.5::DOUBLE * ({i}[k] - {i}[k - 1]) * ({j}[k] - {j}[k - 1])))"
    if not log:
        return one + [f"2 * ({area.format(n=n, i=i, j=j)})" for i in paths for j in paths]
    pairs = [(i, j) for k, i in enumerate(paths) for j in paths[k + 1 :]]
    return one + [f"0.5::DOUBLE * ({area.format(n=n, i=i, j=j)} - {area.format(n=n, i=j, j=i)})" for i, j in pairs]


_CONFIGS = f"""{DATA}, p AS (SELECT y, list(r) OVER (PARTITION BY entity_id ORDER BY step ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS p,
  list(r) OVER (PARTITION BY entity_id ORDER BY step ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s1 FROM data),
c AS (SELECT *, list_concat([0.0::DOUBLE], list_transform(generate_series(1, 11), lambda k: list_sum(p[1:k]))) AS x FROM p),
w AS (SELECT *, list_transform(generate_series(0, 5), lambda k: k / 5.0::DOUBLE) AS s0, list_transform(generate_series(1, 23),
  lambda k: (k // 2) / 11.0::DOUBLE) AS l0, list_transform(generate_series(1, 23), lambda k: x[k // 2 + 1]) AS l1,
  list_transform(generate_series(1, 23), lambda k: ((k - 1) // 2) / 11.0::DOUBLE) AS l2, list_transform(generate_series(1, 23),
  lambda k: x[(k - 1) // 2 + 1]) AS l3 FROM c),
u AS (SELECT y, unnest([{", ".join(f"struct_pack(config := 'short', term := 'sig.term={k}', x := {x})" for k, x in enumerate(_moves(["s0", "s1"], 6)))}]) AS t FROM w WHERE len(s1) = 6
  UNION ALL SELECT y, unnest([{", ".join(f"struct_pack(config := 'long', term := 'sig.term={k}', x := {x})" for k, x in enumerate(_moves(["l0", "l1", "l2", "l3"], 23)))}]) FROM w WHERE len(p) = 11)
SELECT t.config AS config, t.term AS term, count(*) AS n, round(avg(t.x), 6) AS mean, CASE WHEN max(t.x) - min(t.x) > 1e-9::DOUBLE THEN round(corr(y,
  t.x), 6) END AS corr FROM u GROUP BY 1, 2"""


@query(f"WITH {_CONFIGS}")
def signature_configs(spark: S, d: str) -> DataFrame:
    tables = signature.config_tables(dataset(spark, d), ("short:5:2:addtime", "long:10:2:all"))
    return r8(tables, "mean", "corr", digits=6)


_FADE = [(x, h) for x in ("{d}.r", "abs({d}.r)", "{d}.r * {d}.r") for h in (2, 5)]
_FADED = f"""{DATA}, e AS (SELECT entity_id, step, ts_utc, {", ".join(f"{x.format(d='data')} AS s{k}" for k, (x, _) in enumerate(_FADE))} FROM data WHERE step = 0
  UNION ALL SELECT n.entity_id, n.step, n.ts_utc,
  {", ".join(f"pow(2, -1 / {h}.0::DOUBLE) * e.s{k} + (1 - pow(2, -1 / {h}.0::DOUBLE)) * {x.format(d='n')}" for k, (x, h) in enumerate(_FADE))} FROM e
  JOIN data n ON n.entity_id = e.entity_id AND n.step = e.step + 1),
p AS (SELECT entity_id, ts_utc, {", ".join(f"list(s{k}) OVER w AS p{k}" for k in range(6))} FROM e WINDOW w AS (PARTITION BY entity_id
  ORDER BY step ROWS BETWEEN 10 PRECEDING AND CURRENT ROW))
SELECT entity_id, ts_utc, {", ".join(f'CASE WHEN len(p0) = 11 THEN round({x}, 8) + 0.0::DOUBLE END AS "fsig.term={j}"' for j, x in enumerate(_moves([f"p{k}" for k in range(6)], 11, log=True)))} FROM p"""


@query(f"WITH RECURSIVE {_FADED}")
def fading_signature(spark: S, d: str) -> DataFrame:
    rows = signature.fading_features(dataset(spark, d).select("entity_id", "ts_utc", "r"), half_lives=(2, 5), lags=10)
    cols = [c for c in rows.columns if c.startswith("fsig")]
    return rows.select("entity_id", "ts_utc", *((F.round(F.col(f"`{c}`"), 8) + 0.0).alias(c) for c in cols))  # no negative zeros
