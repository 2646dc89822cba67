"""Queries of operators for series, stores and panels too large for one task or one writer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, math
from ..operators import metrics, panel, recursion
from ..streaming import states
from ..models import boosting, pgarch, searching
from .queries_evaluation import _STES
from .catalogue import oracle_of, query
from .panels import ES, GATES, bars, dataset, smoothed, table
from .queries_operators import run_stream, stream
from .queries_panel import r8

S = SparkSession
#: So few rows a block that each series of these tables is cut into dozens.
ROWS = 64


@query(oracle_of("es_recursion"))
def es_recursion_blocks(spark: S, d: str) -> DataFrame:
    models = F.explode(F.array(*(F.struct(F.lit(k).alias("model"), F.lit(v).alias("gate")) for k, v in GATES.items())))
    fan = dataset(spark, d).select("entity_id", "ts_utc", "r", models.alias("m")).select("entity_id", "ts_utc", "r", "m.model", "m.gate")
    return r8(recursion.smooth_by(fan, "r", "gate", by=("entity_id", "model"), block_rows=ROWS).select("entity_id", "model", "ts_utc", "yhat"), "yhat")


@query(oracle_of("variance_filter"))
def variance_filter_blocks(spark: S, d: str) -> DataFrame:
    """The mean of the first 500 squared returns spans eight blocks."""
    return r8(recursion.filter_by(dataset(spark, d), "r", 0.1, block_rows=ROWS).select("entity_id", "ts_utc", "state", "yhat"), "state", "yhat")


@query(oracle_of("ewma_bank"))
def ewma_bank_blocks(spark: S, d: str) -> DataFrame:
    rows = recursion.ewma_by(dataset(spark, d).withColumn("abs_r", F.abs("r")), ["r", "abs_r"], [2.0], block_rows=ROWS)
    return rows.select("entity_id", "ts_utc", *(F.round(F.col(f"`ewma.{c}.hl=2`"), 8).alias(f"ewma.{c}.hl=2") for c in ("r", "abs_r")))


@query(oracle_of("garch11_filter"))
def garch11_filter_blocks(spark: S, d: str) -> DataFrame:
    return r8(recursion.garch_by(dataset(spark, d), "r", 0.05, 0.1, 0.85, 1.0, block_rows=ROWS).select("entity_id", "ts_utc", "h"), "h")


@query(oracle_of("pgarch_path_linear"))
def pgarch_path_blocks(spark: S, d: str) -> DataFrame:
    """The floor of the recursion goes through the blocks as a map max(a h + b, c)."""
    r = F.col("r")
    rows = dataset(spark, d).withColumns({"mu": math.mu_link(-1 + 0.2 * r), "phi": math.bounded_link(2 - 0.1 * r), "g": math.bounded_link(-2 + 0.3 * F.abs(r), math.G_RANGE)})
    return r8(recursion.pgarch_by(rows, "y", "mu", "phi", "g", block_rows=ROWS).select("entity_id", "ts_utc", "h"), "h")


@query(oracle_of("backward_adjoint"))
def backward_adjoint_blocks(spark: S, d: str) -> DataFrame:
    rows = dataset(spark, d).withColumn("rho", 0.9 / (1 + F.col("y")))
    return r8(recursion.adjoint_by(rows, "r", "rho", block_rows=ROWS).select("entity_id", "ts_utc", "pull", "weight"), "pull", "weight")


#: The New York Stock Exchange's full holidays from 1992 to 1998, for the tables' years, in SQL as a list. Fixed values.
_HOLIDAYS = """'1992-01-01', '1992-02-17', '1992-04-17', '1992-05-25', '1992-07-03', '1992-09-07', '1992-11-26', '1992-12-25',
'1993-01-01', '1993-02-15', '1993-04-09', '1993-05-31', '1993-07-05', '1993-09-06', '1993-11-25', '1993-12-24',
'1994-02-21', '1994-04-01', '1994-04-27', '1994-05-30', '1994-07-04', '1994-09-05', '1994-11-24', '1994-12-26',
'1995-01-02', '1995-02-20', '1995-04-14', '1995-05-29', '1995-07-04', '1995-09-04', '1995-11-23', '1995-12-25',
'1996-01-01', '1996-02-19', '1996-04-05', '1996-05-27', '1996-07-04', '1996-09-02', '1996-11-28', '1996-12-25',
'1997-01-01', '1997-02-17', '1997-03-28', '1997-05-26', '1997-07-04', '1997-09-01', '1997-11-27', '1997-12-25',
'1998-01-01', '1998-01-19', '1998-02-16', '1998-04-10', '1998-05-25', '1998-07-03', '1998-09-07', '1998-11-26', '1998-12-25'"""
_SESSIONS = f"""s AS (SELECT day::DATE AS session FROM generate_series(DATE '1992-01-01', DATE '1998-12-31', INTERVAL 1 DAY) t(day)
  WHERE isodow(day) < 6 AND strftime(day, '%Y-%m-%d') NOT IN ({_HOLIDAYS}))"""


@query(f"""WITH {_SESSIONS}, o AS (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate <= TIMESTAMP '1998-12-31')
SELECT day, min(session) AS session, count(DISTINCT o_orderkey) AS orders FROM o ASOF JOIN s ON s.session >= o.day GROUP BY 1""")
def exchange_sessions(spark: S, d: str) -> DataFrame:
    """The session on which each day's orders would be settled: that day's, or the next one behind weekends and holidays."""
    kept = calendar.sessions(spark, "1992-01-01", "1998-12-31")
    orders = table(spark, d, "orders").filter("o_orderdate <= timestamp_ntz'1998-12-31'").select(F.to_date("o_orderdate").alias("day"), F.to_timestamp("o_orderdate").alias("ts_utc"))
    closes = kept.select("session", "close_utc")
    moved = panel.sessionise(orders, sessions=closes)
    return moved.groupBy("day", F.to_date("ts_utc").alias("session")).agg(F.count("*").alias("orders"))


@query(f"""WITH {_SESSIONS}, g(entity_id, gap_from, gap_to) AS (SELECT l_returnflag, min(l_shipdate)::DATE + (i * 7)::INT, min(l_shipdate)::DATE + (i * 7 + i % 4)::INT FROM lineitem, range(0, 200) t(i) GROUP BY 1, i)
SELECT entity_id, gap_from AS asked, min(session) AS gap_from, max(session) AS gap_to FROM g JOIN s ON session BETWEEN gap_from AND gap_to GROUP BY 1, 2""")
def session_gaps(spark: S, d: str) -> DataFrame:
    """Gaps of one to four days of each series, cut to the sessions in them; those on weekends and holidays are gone."""
    first = bars(spark, d).groupBy("entity_id").agg(F.to_date(F.min("ts_utc")).alias("day")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(199))))
    gaps = first.select("entity_id", F.expr("date_add(day, i * 7)").alias("asked"), F.expr("date_add(day, i * 7)").alias("gap_from"), F.expr("date_add(day, i * 7 + i % 4)").alias("gap_to"))
    return calendar.without_sessions(gaps, calendar.sessions(spark, "1992-01-01", "1998-12-31"))


@query(f"""WITH RECURSIVE {ES} SELECT entity_id, model, round(median(r * r / yhat), 6) AS median_ratio, round(sqrt(avg(pow(y - yhat, 2))), 6) AS rmse_of_parts,
  round(max(abs(y - yhat)), 6) AS worst FROM es GROUP BY 1, 2""")
def user_metrics(spark: S, d: str) -> DataFrame:
    """Metrics of the user's own: one that sees a group's arrays, and two put together from parts."""
    rows = smoothed(spark, d)
    root = metrics.Mergeable(lambda y, p: [len(y), ((y - p) ** 2).sum()], lambda parts: parts.sum(0), lambda t: (t[1] / t[0]) ** 0.5)
    worst = metrics.Mergeable(lambda y, p: [abs(y - p).max()], lambda parts: parts.max(0), lambda t: t[0])
    made = metrics.by_functions(rows, ["entity_id", "model"], {"rmse_of_parts": root, "worst": worst})
    ratios = metrics.by_functions(rows.withColumn("sq", F.col("r") * F.col("r")), ["entity_id", "model"], {"median_ratio": lambda y, p: float(np.median(y / p))}, y="sq")
    return r8(made.join(ratios, ["entity_id", "model"]), "median_ratio", "rmse_of_parts", "worst", digits=6)


@query("""WITH RECURSIVE e AS (SELECT event_type AS entity_id, ts, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS k FROM events WHERE value > 0),
x AS (SELECT entity_id, ts, k, ln(price) - lag(ln(price)) OVER (PARTITION BY entity_id ORDER BY k) AS r FROM e),
s AS (SELECT entity_id, ts, k, r * r AS v FROM x WHERE k = 2 UNION ALL SELECT x.entity_id, x.ts, x.k, 0.06::DOUBLE * x.r * x.r + 0.94::DOUBLE * s.v FROM s
  JOIN x ON x.entity_id = s.entity_id AND x.k = s.k + 1)
SELECT entity_id, count(*) AS n, round(max(v), 7) AS highest, round(arg_max(v, k), 7) AS last FROM s
  WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1""")
def stream_states_in_order(spark: S, d: str) -> DataFrame:
    """The variance after every tick that the watermark has passed, whatever the order of arrival."""
    own = states.rocks_session(spark)
    rows = run_stream(spark, states.smoothed_in_order(stream(own, d), late="2 days"), "in-order").filter("state is not null")
    return r8(rows.groupBy("entity_id").agg(F.count("*").alias("n"), F.max("state").alias("highest"), F.max_by("state", "k").alias("last")), "highest", "last", digits=7)


class FixedGates:
    """An initialiser with given coefficients: gates of the row's return and its size."""

    def gates(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(-2 + 3 * x[:, 1] - 0.5 * x[:, 0])))


@query(f"""WITH RECURSIVE {_STES}, i AS (SELECT entity_id, greatest(avg(r * r), 1e-8::DOUBLE) AS v0 FROM data WHERE step < 500 GROUP BY 1),
b AS (SELECT g.entity_id, g.step, g.ts_utc, g.gate * g.r * g.r + (1 - g.gate) * v0 AS yhat FROM g JOIN i USING (entity_id) WHERE step = 0
  UNION ALL SELECT g.entity_id, g.step, g.ts_utc, g.gate * g.r * g.r + (1 - g.gate) * b.yhat FROM b JOIN g ON g.entity_id = b.entity_id AND g.step = b.step + 1)
SELECT entity_id, ts_utc, round(yhat, 8) AS yhat FROM b""")
def boosted_from_gates(spark: S, d: str) -> DataFrame:
    """A boosted smoother that starts from given gates and grows no tree is the smoother of these gates."""

    def step(g) -> dict:
        x, y, r = np.column_stack([g["r"], g["r"].abs()]), g["y"].to_numpy(float), g["r"].to_numpy(float)
        return {"yhat": boosting.BoostedSmoother(rounds=0, valid=0.0, init=FixedGates()).fit(x, y, r).predict(x, r)}

    return r8(recursion.per_group(dataset(spark, d), ["entity_id"], ["ts_utc"], ["yhat"], step).select("entity_id", "ts_utc", "yhat"), "yhat")


class FixedComponents:
    """An initialiser of the level, persistence and gate of ``pgarch_path_linear``."""

    def predict_components(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        r = x[:, 0]
        return pgarch.links(-1 + 0.2 * r, 2 - 0.1 * r, -2 + 0.3 * np.abs(r))[0]

    def predict_variance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return recursion.pgarch(y, *self.predict_components(x))


@query(oracle_of("pgarch_path_linear"))
def boosted_from_components(spark: S, d: str) -> DataFrame:
    """Boosted channels that start from given components and grow no tree are the recursion of these components."""

    def step(g) -> dict:
        x, y = g[["r"]].to_numpy(float), g["y"].to_numpy(float)
        return {"h": pgarch.BoostedPGarch(rounds=0).fit(x, y, FixedComponents()).predict_variance(x, y)}

    return r8(recursion.per_group(dataset(spark, d), ["entity_id"], ["ts_utc"], ["h"], step).select("entity_id", "ts_utc", "h"), "h")


@query()
def adaptive_parameters(spark: S, d: str) -> DataFrame:
    """Penalty and loss of a smoother for each series, by adaptive search over its expanding folds."""
    rows = dataset(spark, d).withColumn("abs_r", F.abs("r"))
    base = {"kind": "stes", "columns": ["r", "abs_r"], "params": {"restarts": 1}}
    found, _ = searching.adaptive_search(rows, base, {"l2": searching.Span(1e-4, 10, log=True), "burn_in": searching.Span(0, 50, whole=True)}, rounds=2, per_round=4, splits=3)
    return r8(found, "score", digits=6)
