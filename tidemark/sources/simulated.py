"""Simulated prices with a contaminated GARCH(1,1) variance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FetchResult, Query
from ..operators.panel import entities_in, time_range

_SCHEMA = "entity_id string, ts_utc timestamp_ntz, open double, high double, low double, close double, volume double, ret double, sigma2 double"


def path(n: int, seed: int, mu: float = 0.0, omega: float = 0.02, alpha: float = 0.11, beta: float = 0.87, eta: float = 4.0, shock_prob: float = 0.005) -> tuple[np.ndarray, np.ndarray]:
    """Returns (in percent) and their variances; now and then a return takes a shock of ``eta``, which feeds the variance."""
    g = np.random.default_rng(seed)
    normal, shock = g.standard_normal(n), (g.random(n) < shock_prob) * eta
    r, s2 = np.empty(n), np.empty(n)
    for t in range(n):
        s2[t] = omega / max(1 - alpha - beta, 1e-6) if t == 0 else omega + alpha * r[t - 1] ** 2 + beta * s2[t - 1]
        r[t] = mu + np.sqrt(s2[t]) * normal[t] + shock[t]
    return r, s2


def simulate(spark: SparkSession, seeds: list[int], n: int = 2500, start: str = "2000-01-03", **params: float) -> DataFrame:
    """One entity ``SIM<seed>`` a seed, each a task's group: flat bars of price 100 * prod(1 + r / 100)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seed = int(group["seed"].iloc[0])
        r, s2 = path(n, seed, **params)
        price = 100 * np.cumprod(np.maximum(1 + r / 100, 1e-6))
        days = pd.bdate_range(start, periods=n).astype("datetime64[us]")
        return pd.DataFrame({"entity_id": f"SIM{seed}", "ts_utc": days, "open": price, "high": price, "low": price, "close": price, "volume": 1e6, "ret": r, "sigma2": s2})

    rows = spark.createDataFrame([(int(s),) for s in seeds], "seed long")
    return rows.groupBy("seed").applyInPandas(run, _SCHEMA)


def permuted(df: DataFrame, column: str, seeds: list[int], by: str = "entity_id", time: str = "ts_utc") -> DataFrame:
    """Each series once for each seed, with its values of ``column`` in an order drawn by the seed: the same distribution without its dependence in time.

    ``seed`` is a further column; times stay, so that a study of the permuted series stands beside that of the series itself.
    """
    fan = df.select(by, time, column).withColumn("seed", F.explode(F.array(*(F.lit(int(s)) for s in seeds))))
    keys = ["seed", by]
    drawn = fan.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("seed", F.col(time).cast("string"), column), time))).select(*keys, "_k", column)
    times = fan.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(time))).select(*keys, "_k", time)
    return times.join(drawn, [*keys, "_k"]).drop("_k")


def study_seeds(n: int, base: int = 42) -> list[int]:
    return np.random.default_rng(base).integers(0, 1_000_000, n).tolist()


class SimulatedSource:
    name, datasets = "simulated", ("market.ohlcv",)

    def __init__(self, n: int = 2500, **params: float):
        self.n, self.params = n, params

    def list_entities(self, seeds: list[int]) -> list[str]:
        return [f"SIM{s}" for s in seeds]

    def fetch(self, spark: SparkSession, q: Query) -> FetchResult:
        if q.table not in self.datasets:
            raise KeyError(f"{self.name} has no table {q.table}")
        if not q.entities:
            raise ValueError("entities are required")
        rows = simulate(spark, [int(str(e).removeprefix("SIM")) for e in q.entities], self.n, **self.params)
        kept = entities_in(time_range(rows, q.start, q.end, q.asof), q.entities)
        return FetchResult(kept.select("ts_utc", "entity_id", *q.columns).withColumn("asof_utc", F.lit(None).cast("timestamp")), self.name, q.table, meta={"params": self.params})

    def fetch_series(self, spark: SparkSession, q: Query) -> DataFrame:
        """The same rows under the adapter's key names."""
        return self.fetch(spark, q).data.withColumnsRenamed({"entity_id": "series_key", "ts_utc": "obs_date"})
