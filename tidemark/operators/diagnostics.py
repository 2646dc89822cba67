"""Diagnostics of gates and forecasts: best gates, reconstruction, calibration, win and lose events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.math import best_gate, logit
from . import metrics
from .windows import by_entity, quantile_bins


def gate_frame(df: DataFrame, by: Sequence[str], gate: str = "gate", yhat: str = "yhat", returns: str = "r", target: str = "y", time: str = "ts_utc", least: float = 1e-12) -> DataFrame:
    """Per row: the state before the return (the last forecast), the move r2 - state, the best gate, and the gate's forecast."""
    w = W.partitionBy(*by).orderBy(time)
    state = F.lag(yhat).over(w)
    r2 = F.col(returns) * F.col(returns)
    out = df.withColumn("state", state).withColumn("move", r2 - F.col("state"))
    out = out.withColumn("best_gate", F.when(F.col("state").isNotNull(), best_gate(F.col(target), F.col("state"), r2, least=least)))
    return out.withColumn("rebuilt", F.col("state") + F.col(gate) * F.col("move"))


def oracle_table(df: DataFrame, by: Sequence[str], gate: str = "gate", target: str = "y") -> DataFrame:
    """RMSE of the gate, of its mean and of the best gate on the same states, the share of the gap left, and the rebuild error."""
    rows = df.filter(F.col("state").isNotNull())
    constant = F.avg(gate).over(W.partitionBy(*by))
    ways = {"own": F.col(gate), "constant": constant, "best": F.col("best_gate")}
    rows = rows.withColumns({f"_{k}": F.col("state") + a * F.col("move") for k, a in ways.items()})
    errors = rows.groupBy(*by).agg(*(metrics.rmse(F.col(target), F.col(f"_{k}")).alias(f"rmse_{k}") for k in ways), F.max(F.abs(F.col("rebuilt") - F.col("yhat"))).alias("rebuild_error"))
    gap = (F.col("rmse_own") - F.col("rmse_best")) / (F.col("rmse_constant") - F.col("rmse_best") + 1e-12)
    return errors.withColumn("gap_left", gap).withColumn("rebuild_ok", F.col("rebuild_error") <= 1e-8)


def gate_report(df: DataFrame, by: Sequence[str], gate: str = "gate", target: str = "y") -> DataFrame:
    """``oracle_table`` with what the best gate and the gate itself gain on the constant, and the rank correlation of the two."""
    from .stats import spearman

    table = oracle_table(df, by, gate, target)
    table = table.withColumns({"gain_best": F.col("rmse_constant") - F.col("rmse_best"), "gain_own": F.col("rmse_constant") - F.col("rmse_own")})
    return table.join(spearman(df.filter(F.col("state").isNotNull()), by, gate, "best_gate"), list(by))


def gate_diagnostics(df: DataFrame, gate: str = "gate", target: str = "y", yhat: str = "yhat", least: float = 1e-12, edge: float = 1e-6) -> DataFrame:
    """Rows of ``gate_frame`` with both logits, the forecast's error, its squared loss, and whether the move is large enough to tell a best gate."""
    error = F.col(target) - F.col(yhat)
    return df.withColumns({"told": F.abs("move") > least, "logit_gate": logit(F.col(gate), edge), "logit_best": logit(F.col("best_gate"), edge), "error": error, "loss": error * error})


def ranked_coefficients(df: DataFrame, by: Sequence[str], name: str = "feature", value: str = "value", k: int | None = None) -> DataFrame:
    """Rank of each coefficient by its size within ``by``, ties by name; only the first k."""
    rows = df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.abs(value).desc(), name)))
    return rows if k is None else rows.filter(F.col("rank") <= k)


def mean_path(events: DataFrame, value: str, window: int, by: str = "entity_id", time: str = "ts_utc") -> DataFrame:
    """(event, offset, mean, n): the mean of ``value`` around each kind of event whose whole window is there."""
    around = F.collect_list(F.coalesce(value, F.lit(float("nan")))).over(by_entity(by, time).rowsBetween(-window, window))
    taken = events.withColumn("_path", around).filter(F.col("event").isNotNull() & (F.size("_path") == 2 * window + 1))
    long = taken.select("event", F.posexplode("_path").alias("k", "x")).filter(~F.isnan("x"))
    return long.groupBy("event", (F.col("k") - window).alias("offset")).agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def calibration(df: DataFrame, value: str = "best_gate", other: str = "gate", bins: int = 10) -> DataFrame:
    rows = quantile_bins(df.filter(F.col(value).isNotNull()), value, bins)
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(value).alias("mean_best"), F.avg(other).alias("mean_gate"))


def mismatch(df: DataFrame, bins: int = 5, gate: str = "gate", target: str = "y", yhat: str = "yhat") -> DataFrame:
    """Errors by bin of the distance between gate and best gate."""
    rows = quantile_bins(df.filter("best_gate is not null").withColumn("_gap", F.abs(F.col(gate) - F.col("best_gate"))), "_gap", bins)
    return rows.groupBy("bin").agg(
        F.count("*").alias("n"), metrics.rmse(F.col(target), F.col(yhat)).alias("rmse"), metrics.mae(F.col(target), F.col(yhat)).alias("mae"), F.avg("_gap").alias("mean_gap"), F.avg(F.abs("move")).alias("mean_move")
    )


def boundary_mass(df: DataFrame, by: Sequence[str], gate: str = "gate", low: float = 0.01, high: float = 0.99) -> DataFrame:
    rows = df.filter(F.col(gate).isNotNull())
    return rows.groupBy(*by).agg(F.avg((F.col(gate) <= low).cast("double")).alias("at_0"), F.avg((F.col(gate) >= high).cast("double")).alias("at_1"))


def contributions(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Score contributions x * beta of a linear gate, and the score."""
    cols = {f"c_{c}": F.col(f"`{c}`") * b for c, b in coefficients.items()}
    total = None
    for c in cols.values():
        total = c if total is None else total + c
    return df.withColumns({**cols, "score": total})


def coefficient_table(df: DataFrame, coefficients: Sequence[str]) -> DataFrame:
    """(name, value, effect) rows of a one-row frame of coefficients, largest first."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in coefficients))).alias("x")).select("x.*")
    return long.withColumn("effect", F.when(F.col("value") > 0, "raises gate").when(F.col("value") < 0, "lowers gate").otherwise("none")).orderBy(F.abs("value").desc(), "name")


def win_lose(df: DataFrame, difference: Column, share: float = 0.05, by: str = "entity_id") -> DataFrame:
    """``event``: win or lose where the loss difference is among the entity's largest or smallest ``share``."""
    rows = df.withColumn("d", difference)
    edges = rows.groupBy(by).agg(F.percentile("d", F.array(F.lit(share), F.lit(1 - share))).alias("_q"))
    joined = rows.join(edges, by)
    return joined.withColumn("event", F.when(F.col("d") >= F.col("_q")[1], "win").when(F.col("d") <= F.col("_q")[0], "lose")).drop("_q")


def event_summary(df: DataFrame, means: Sequence[str], positive: Sequence[str]) -> DataFrame:
    rows = df.filter(F.col("event").isNotNull())
    return rows.groupBy("event").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in means), *(F.avg((F.col(c) > 0).cast("double")).alias(f"share_{c}") for c in positive))


def top_by_size(df: DataFrame, value: str, k: int, tie: str) -> DataFrame:
    """The k rows of largest size, in the order of the value."""
    return df.orderBy(F.abs(value).desc(), tie).limit(k).orderBy(value, tie)


def shifted_gate(df: DataFrame, gate: str = "gate") -> DataFrame:
    """Gate rows beside the last row's return: what a gate plot shows."""
    return df.withColumn("last_abs_r", F.abs(F.lag("r").over(by_entity()))).dropna(subset=[gate, "last_abs_r"])
