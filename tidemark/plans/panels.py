"""The panels that the registered queries run on, derived alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.math import log_price
from ..operators import recursion
from ..operators.panel import to_steps
from ..operators.windows import by_entity, log_return

GATES = {"es_slow": 0.03, "es_mid": 0.06, "es_fast": 0.2}
_TICK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of three entities: a line item is a trade at its unit price.

    The first pass is a hash aggregate of plain numbers. Only trades of the first and last order of a bar come back for
    open and close, whose order is that of whole rows; an aggregate by struct over all trades would have to sort them.
    """
    trades = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice") / F.col("l_quantity"))
    keys = [F.col("l_returnflag").alias("entity_id"), F.col("l_shipdate").alias("ts_utc")]
    wide = trades.groupBy(*keys).agg(F.max("p").alias("high"), F.min("p").alias("low"), F.sum("l_quantity").alias("volume"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))
    edge = trades.select(*keys, "p", "l_orderkey", F.struct(*_TICK).alias("k")).join(wide.select("entity_id", "ts_utc", "first", "last"), ["entity_id", "ts_utc"])
    edge = edge.filter((F.col("l_orderkey") == F.col("first")) | (F.col("l_orderkey") == F.col("last")))
    ends = edge.groupBy("entity_id", "ts_utc").agg(F.min_by("p", "k").alias("open"), F.max_by("p", "k").alias("close"))
    return wide.join(ends, ["entity_id", "ts_utc"]).select("entity_id", "ts_utc", "open", "high", "low", "close", "volume")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("r", log_return())


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns and the next squared return, complete rows only, numbered from 0."""
    w = by_entity()
    r = returns(spark, sf_dir)
    nxt = log_price(F.lead("close").over(w)) - log_price(F.col("close"))
    return to_steps(r.withColumn("y", nxt * nxt).dropna(subset=["r", "y"]).select("entity_id", "ts_utc", "close", "volume", "r", "y"))


def smoothed(spark: SparkSession, sf_dir: str, entity: str | None = None) -> DataFrame:
    """The constant-gate forecasts of three models, long: every (entity, model) is a group of its own. One ``entity`` alone is chosen below the recursion."""
    models = F.explode(F.array(*(F.struct(F.lit(k).alias("model"), F.lit(v).alias("gate")) for k, v in GATES.items())))
    rows = dataset(spark, sf_dir)
    rows = rows if entity is None else rows.filter(F.col("entity_id") == entity)
    fan = rows.select("entity_id", "ts_utc", "step", "r", "y", models.alias("m")).select("entity_id", "ts_utc", "step", "r", "y", "m.model", "m.gate")
    return recursion.smooth_by(fan, "r", "gate", by=("entity_id", "model"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("entity_id"), "ts", F.col("value").alias("price"), "event_id", "user_id")


BARS = """bars AS (SELECT l_returnflag AS entity_id, l_shipdate AS ts_utc, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS k FROM lineitem) GROUP BY 1, 2)"""
RETS = BARS + """,
rets AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY entity_id ORDER BY ts_utc) AS r FROM bars)"""
DATA = RETS + """,
d0 AS (SELECT *, pow(lead(r) OVER (PARTITION BY entity_id ORDER BY ts_utc), 2) AS y FROM rets),
data AS (SELECT entity_id, ts_utc, close, volume, r, y, row_number() OVER (PARTITION BY entity_id ORDER BY ts_utc) - 1 AS step FROM d0 WHERE r IS NOT NULL AND y IS NOT NULL)"""
ES = DATA + """,
gates(model, gate) AS (VALUES ('es_slow', 0.03::DOUBLE), ('es_mid', 0.06::DOUBLE), ('es_fast', 0.2::DOUBLE)),
es AS (SELECT entity_id, model, gate, step, ts_utc, r, y, r * r AS yhat FROM data, gates WHERE step = 0
  UNION ALL SELECT d.entity_id, e.model, e.gate, d.step, d.ts_utc, d.r, d.y, e.gate * d.r * d.r + (1 - e.gate) * e.yhat FROM es e JOIN data d ON d.entity_id = e.entity_id AND d.step = e.step + 1)"""
