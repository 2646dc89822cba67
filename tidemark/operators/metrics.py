"""Losses and summaries of forecasts, as aggregate columns for any grouping of (y, yhat) rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.math import clip, finite

Value = Column | str


def _c(x: Value) -> Column:
    return F.col(x) if isinstance(x, str) else x


LOWER_IS_BETTER = ("qlike", "rmse", "mae")


def rmse(y: Value = "y", yhat: Value = "yhat") -> Column:
    gap = _c(y) - _c(yhat)
    return F.sqrt(F.avg(gap * gap))


def mae(y: Value = "y", yhat: Value = "yhat") -> Column:
    return F.avg(F.abs(_c(y) - _c(yhat)))


def medae(y: Value = "y", yhat: Value = "yhat") -> Column:
    return F.median(F.abs(_c(y) - _c(yhat)))


def qlike(y: Value = "y", yhat: Value = "yhat", eps: float = 1e-8) -> Column:
    """Mean of ratio - ln ratio - 1, both sides held above eps."""
    ratio = clip(_c(y), eps) / clip(_c(yhat), eps)
    return F.avg(ratio - F.log(ratio) - 1)


def qlike_gaussian(y: Value = "y", h: Value = "yhat") -> Column:
    """Mean of ln h + y / h over positive h."""
    up = F.when(_c(h) > 0, _c(h))
    return F.avg(F.log(up) + _c(y) / up)


def nll(v: Column, r2_next: Column, least: float = 1e-12) -> Column:
    floor = clip(v, least)
    return F.avg(0.5 * (F.log(floor) + r2_next / floor))


def corr(y: Value = "y", yhat: Value = "yhat") -> Column:
    """Pearson's; null for fewer than two rows or a constant side."""
    y, yhat = _c(y), _c(yhat)
    both = y.isNotNull() & yhat.isNotNull()
    y, yhat = F.when(both, y), F.when(both, yhat)
    return F.when(F.count(y) >= 2, F.try_divide(F.covar_pop(y, yhat), F.stddev_pop(y) * F.stddev_pop(yhat)))


@dataclass(frozen=True)
class Mergeable:
    """A user's metric that is made of parts: numbers of some rows, those of two or more parts together, and the metric of all.

    ``partial(y, yhat)`` gives a list of numbers, ``merge(rows of these)`` one such list, ``finish(list)`` the metric.
    """

    partial: Callable[[np.ndarray, np.ndarray], Sequence[float]]
    merge: Callable[[np.ndarray], Sequence[float]]
    finish: Callable[[np.ndarray], float]


#: A user's metric: a function of the arrays y and yhat, or one that can be put together from parts.
Function = Callable[[np.ndarray, np.ndarray], float] | Mergeable


def by_functions(df: DataFrame, by: Sequence[str], functions: dict[str, Function], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """A row a group of ``by`` with a column for each of the user's metrics; pairs with a null or NaN side are left out.

    A plain function is a grouped aggregate in Arrow batches: it sees a group's arrays whole, which is right for medians and the like, in groups that a task can
    hold. A ``Mergeable`` is summed up where the rows lie: each batch gives its groups' numbers, which alone are shuffled, so that
    a group may have any number of rows. NaN, and what no rows are left for, is null.
    """
    if not by:
        return by_functions(df.withColumn("_all", F.lit(True)), ["_all"], functions, y, yhat).drop("_all")
    rows = df.select(*by, F.col(y).cast("double").alias("_y"), F.col(yhat).cast("double").alias("_yhat"))
    present = F.col("_y").isNotNull() & F.col("_yhat").isNotNull() & ~F.isnan("_y") & ~F.isnan("_yhat")
    kinds = [f for f in rows.schema.fields if f.name in by]
    out = rows.select(*by).distinct()

    def keep(found: DataFrame, names: Sequence[str]) -> DataFrame:
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
        joined = out.alias("l").join(found.alias("r"), same, "left")
        return joined.select("l.*", *(F.when(~F.isnan(F.col(f"r.{n}")), F.col(f"r.{n}")).alias(n) for n in names))

    plain = {n: f for n, f in functions.items() if not isinstance(f, Mergeable)}
    if plain:

        def aggregate(f: Callable[[np.ndarray, np.ndarray], float]) -> Callable[..., Column]:
            def whole(a: pd.Series, b: pd.Series) -> float:
                return float(f(a.to_numpy(float), b.to_numpy(float)))

            return F.pandas_udf(whole, "double")

        out = keep(rows.filter(present).groupBy(*by).agg(*(aggregate(f)("_y", "_yhat").alias(n) for n, f in plain.items())), list(plain))
    merged = {n: f for n, f in functions.items() if isinstance(f, Mergeable)}
    if merged:
        states = T.StructType([*kinds, *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in merged)])

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = []
                for key, g in batch.groupby(list(by), dropna=False, sort=False):
                    a, b = g["_y"].to_numpy(float), g["_yhat"].to_numpy(float)
                    made.append((*key, *(np.asarray(f.partial(a, b), float) for f in merged.values())))
                yield pd.DataFrame(made, columns=[*by, *merged]).astype({c: batch[c].dtype for c in by})

        def finish(group: pd.DataFrame) -> pd.DataFrame:
            numbers = {n: float(f.finish(np.asarray(f.merge(np.stack(group[n].to_list())), float))) for n, f in merged.items()}
            return group[list(by)].head(1).assign(**numbers)

        schema = T.StructType([*kinds, *(T.StructField(n, T.DoubleType()) for n in merged)])
        out = keep(rows.filter(present).mapInPandas(partial, states).groupBy(*by).applyInPandas(finish, schema), list(merged))
    return out


def with_moves(df: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    """The signs of the relative changes of y and yhat (``_dy``, ``_dh``): null at the start and from 0 to 0. ``order`` has to settle ties."""
    w = W.partitionBy(*by).orderBy(*(order or ("ts_utc",)))

    def sign(c: str) -> Column:
        x, last = F.col(c), F.lag(c).over(w)
        return F.when(last > 0, F.signum(x - last)).when((last == 0) & (x > 0), F.lit(1.0))

    return df.withColumns({"_dy": sign("y"), "_dh": sign("yhat")})


def hit_rate() -> Column:
    both = F.col("_dy").isNotNull() & F.col("_dh").isNotNull()
    return F.avg(F.when(both, (F.col("_dy") == F.col("_dh")).cast("double")))


def by_model(df: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    return with_moves(df, by, *order).groupBy(*by).agg(F.count("*").alias("n_obs"), qlike().alias("qlike"), rmse().alias("rmse"), mae().alias("mae"), hit_rate().alias("hit_rate"), corr().alias("corr"))


def ranked(board: DataFrame, primary: str = "qlike", tie: str = "model") -> DataFrame:
    """Best first; the board has a row a model, which is what the unpartitioned window sees."""
    order = F.col(primary).asc_nulls_last() if primary in LOWER_IS_BETTER else F.col(primary).desc_nulls_last()
    return board.withColumn("rank", F.row_number().over(W.orderBy(order, tie)))


def score_by(df: DataFrame, by: Sequence[str], metric: Column, name: str) -> DataFrame:
    return df.groupBy(*by).agg(metric.alias(name))


def ranked_within(scores: DataFrame, by: Sequence[str], primary: str = "qlike", tie: str = "model") -> DataFrame:
    """Best first within each of ``by``, ties by name."""
    order = F.col(primary).asc_nulls_last() if primary in LOWER_IS_BETTER else F.col(primary).desc_nulls_last()
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(order, tie)).cast("long"))


def ensemble(df: DataFrame, by: Sequence[str], value: str = "yhat") -> DataFrame:
    """The mean over models or seeds of each of ``by``."""
    return df.groupBy(*by).agg(F.avg(value).alias(f"{value}_mean"))


def trimmed_rmse(df: DataFrame, by: Sequence[str], trim: float = 0.05) -> DataFrame:
    """Without the largest share ``trim`` of squared errors; at least one row stays."""
    se = (F.col("y") - F.col("yhat")) * (F.col("y") - F.col("yhat"))
    w = W.partitionBy(*by)
    ranks = df.withColumn("se", se).withColumn("k", F.row_number().over(w.orderBy("se"))).withColumn("n", F.count("*").over(w))
    kept = ranks.filter(F.col("k") <= F.greatest(F.floor((1.0 - trim) * F.col("n")), F.lit(1)))
    return kept.groupBy(*by).agg(F.sqrt(F.avg("se")).alias("trimmed_rmse"))


def regimes(df: DataFrame, by: Sequence[str], model: str = "model") -> DataFrame:
    """Errors in the thirds of y, whose edges are those of the entity's distinct outcomes over all models' rows."""
    edges = df.groupBy(*[c for c in by if c != model]).agg(F.percentile("y", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    keys = [c for c in by if c != model]
    joined = df.join(edges, keys) if keys else df.crossJoin(F.broadcast(edges))
    low, high = F.col("y") <= F.col("q")[0], F.col("y") > F.col("q")[1]
    part = lambda f, cond: f(F.when(cond, F.col("y")), F.when(cond, F.col("yhat")))
    return joined.groupBy(*by).agg(
        part(rmse, low).alias("low_rmse"), part(rmse, ~low & ~high).alias("mid_rmse"), part(rmse, high).alias("high_rmse"), part(medae, low).alias("low_medae"), part(medae, high).alias("high_medae")
    )


def gate_summary(df: DataFrame, by: Sequence[str], gate: str = "gate", size: str = "abs_r") -> DataFrame:
    a, s = F.col(gate), F.col(size)
    seen = df.filter(finite(a) & finite(s))
    share = lambda cond: F.avg(cond.cast("double"))
    return seen.groupBy(*by).agg(F.avg(a).alias("gate_mean"), F.stddev_pop(a).alias("gate_std"), share(a < 0.1).alias("share_low"), share(a > 0.9).alias("share_high"), corr(a, s).alias("corr_size"))


def mad_sigma(df: DataFrame, value: str, by: Sequence[str], least: float = 1e-12) -> DataFrame:
    """1.4826 times the median distance from the median, not below ``least``."""
    middle = df.groupBy(*by).agg(F.median(value).alias("_m"))
    return df.join(middle, list(by)).groupBy(*by).agg(F.greatest(1.4826 * F.median(F.abs(F.col(value) - F.col("_m"))), F.lit(least)).alias("sigma"))


def blend(df: DataFrame, by: Sequence[str], scores: Sequence[str], weight: str = "weight") -> DataFrame:
    """Experts' scores by normalised weights."""
    return df.groupBy(*by).agg(*((F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(c) for c in scores))


def seeds(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    v = F.when(finite(F.col(value)), F.col(value))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"), F.count(v).alias("n"))


def gate_alignment(df: DataFrame, by: Sequence[str], gate: str = "gate", best: str = "best_gate", weight: str = "move", least: float = 1e-12) -> DataFrame:
    """How a gate follows the best gate, on rows whose move is not too small."""
    from ..functions.math import logit

    ok = F.abs(F.col(weight)) > least
    a, b = F.when(ok, F.col(gate)), F.when(ok, F.col(best))
    gap = logit(a, 1e-6) - logit(b, 1e-6)
    return df.groupBy(*by).agg(
        F.avg(a).alias("gate_mean"), F.stddev_pop(a).alias("gate_std"), F.avg(b).alias("best_mean"), F.stddev_pop(b).alias("best_std"), corr(a, b).alias("corr"),
        F.sqrt(F.avg(gap * gap)).alias("logit_rmse"), F.avg(F.abs(a - b)).alias("mae"), F.avg(ok.cast("double")).alias("share"),
    )


def group_penalty(df: DataFrame, feature: str, value: str, eps: float = 1e-12) -> DataFrame:
    """One row: the sum over features of the root of their squared coefficients' sum."""
    return df.groupBy(feature).agg(F.sqrt(F.sum(F.col(value) * F.col(value)) + eps).alias("norm")).agg(F.sum("norm").alias("penalty"))


def error_quantiles(df: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """q10, q50, ... of the absolute error of each of ``by``."""
    e = F.abs(F.col("y") - F.col("yhat"))
    return df.groupBy(*by).agg(*(F.percentile(e, q).alias(f"q{round(100 * q)}") for q in shares))


def errors_on(df: DataFrame, day: str, time: str = "ts_utc") -> DataFrame:
    """Actual less forecast of each model on one day."""
    return df.filter(F.to_date(time) == F.lit(day).cast("date")).withColumn("error", F.col("y") - F.col("yhat"))
