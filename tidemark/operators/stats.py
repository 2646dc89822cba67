"""Forecast-comparison tests: long-run variance, equal accuracy, and calibration regressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.math import log_price


def bandwidth(n: Column) -> Column:
    return F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int")


def long_run_variance(df: DataFrame, value: str, by: Sequence[str], time: str = "ts_utc", most_lags: int = 64) -> DataFrame:
    """n, mean, bandwidth and the Newey-West variance with Bartlett weights.

    One sort: a row takes its last ``most_lags`` centred values as an array, and the weighted products are summed by one
    aggregation. The bandwidth of 27 million rows is 64; a longer series is an error that asks for more ``most_lags``.
    """
    group, ordered = W.partitionBy(*by), W.partitionBy(*by).orderBy(time)
    x = F.col(value)
    centred = df.select(*by, time, (x - F.avg(x).over(group)).alias("_c"), F.avg(x).over(group).alias("_m"), F.count(x).over(group).alias("_n"))
    wide = bandwidth(F.col("_n"))
    lags = F.when(wide <= most_lags, wide).otherwise(F.raise_error(F.lit(f"the bandwidth is above most_lags={most_lags}")).cast("int"))
    past = F.collect_list("_c").over(ordered.rowsBetween(-most_lags, -1))
    weighed = centred.withColumn("_l", lags).withColumn("_p", F.reverse(past))
    products = F.aggregate(
        F.transform(F.slice("_p", 1, F.greatest(F.col("_l"), F.lit(1))), lambda c, i: F.when(i < F.col("_l"), 2 * (1 - (i + 1) / (F.col("_l") + 1.0)) * c).otherwise(0.0)),
        F.lit(0.0),
        lambda a, c: a + c,
    )
    term = F.col("_c") * (F.col("_c") + products)
    return weighed.withColumn("_t", term).groupBy(*by).agg(F.first("_n").alias("n"), F.first("_m").alias("mean"), F.first("_l").alias("lags"), (F.sum("_t") / F.first("_n")).alias("lrv"))


def diebold_mariano(df: DataFrame, by: Sequence[str], loss_a: str = "loss_a", loss_b: str = "loss_b", time: str = "ts_utc") -> DataFrame:
    """n, mean loss difference and the statistic; null where the long-run variance is not positive."""
    lrv = long_run_variance(df.withColumn("_d", F.col(loss_a) - F.col(loss_b)), "_d", by, time)
    return lrv.select(*by, "n", F.col("mean").alias("mean_d"), "lags", F.when(F.col("lrv") > 0, F.col("mean") / F.sqrt(F.col("lrv") / F.col("n"))).alias("dm"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def student_p(t: float, df: float, alternative: str = "two-sided") -> float:
    """Tail probability of a t statistic."""
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    upper = tail if t >= 0 else 1 - tail
    return {"two-sided": 2 * tail, "greater": upper, "less": 1 - upper}[alternative]


def with_p_value(dm: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """``p`` beside the statistic; a row a comparison goes through Python."""

    @F.pandas_udf("double")
    def p(stat: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if np.isnan(t) or k < 2 else student_p(t, k - 1, alternative) for t, k in zip(stat, n, strict=True)], dtype="float64")

    return dm.withColumn("p", p("dm", "n"))


def mincer_zarnowitz(df: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat", log: bool = False, constant: bool = True) -> DataFrame:
    """Intercept, slope, their t values and R2 of y on yhat (of logs of positive values, or without intercept)."""
    a, b = (log_price(F.col(y)), log_price(F.col(yhat))) if log else (F.col(y), F.col(yhat))
    rows = df.select(*by, a.alias("_y"), b.alias("_x")).filter("_y is not null and _x is not null")
    if not constant:
        sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.expr("_x * _x")).alias("sxx"), F.sum(F.expr("_x * _y")).alias("sxy"), F.sum(F.expr("_y * _y")).alias("syy"))
        slope = F.col("sxy") / F.col("sxx")
        sse = F.col("syy") - slope * F.col("sxy")
        return sums.select(*by, "n", slope.alias("beta"), (slope / F.sqrt(sse / (F.col("n") - 1) / F.col("sxx"))).alias("t_beta"), (1 - sse / F.col("syy")).alias("r2"))
    sums = rows.groupBy(*by).agg(
        F.regr_count("_y", "_x").alias("n"), F.regr_slope("_y", "_x").alias("beta"), F.regr_intercept("_y", "_x").alias("alpha"), F.regr_r2("_y", "_x").alias("r2"),
        F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"), F.avg("_x").alias("mx"),
    )
    s2 = F.col("syy") * (1 - F.col("r2")) / (F.col("n") - 2)
    return sums.select(
        *by, "n", "alpha", "beta", (F.col("alpha") / F.sqrt(s2 * (1.0 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx")))).alias("t_alpha"), (F.col("beta") / F.sqrt(s2 / F.col("sxx"))).alias("t_beta"), "r2"
    )


def fitted(df: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Rows with the regression's fitted value and residual."""
    line = df.groupBy(*by).agg(F.regr_slope(y, yhat).alias("_b"), F.regr_intercept(y, yhat).alias("_a"))
    fit = F.col("_a") + F.col("_b") * F.col(yhat)
    return df.join(line, list(by)).withColumn("fitted", fit).withColumn("resid", F.col(y) - F.col("fitted")).drop("_a", "_b")


def spearman(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    from .metrics import corr
    from .windows import rank_average

    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.select(*by, rank_average(a, by).alias("_a"), rank_average(b, by).alias("_b")).groupBy(*by).agg(corr("_a", "_b").alias("spearman"))


def newey_west(d: np.ndarray) -> float:
    """The same long-run variance of one array, for tests and small samples."""
    n, c = len(d), d - d.mean()
    lags = int(4 * (n / 100) ** (2 / 9))
    return float(c @ c / n + sum(2 * (1 - k / (lags + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, lags + 1)))
