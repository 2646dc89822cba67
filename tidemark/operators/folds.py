"""Walk-forward folds as tables, and their join to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def walk_forward(spark: SparkSession, n: int, mode: str = "expanding", train: int = 2000, val: int = 252, step: int = 252, max_folds: int | None = None) -> DataFrame:
    """(fold, train_from, train_to, val_to): half-open steps; validation follows training at once."""
    if mode not in ("expanding", "rolling"):
        raise ValueError("mode must be expanding or rolling")
    if min(train, val, step) <= 0:
        raise ValueError("sizes must be positive")
    many = max(0, (n - train - val) // step + 1)
    many = many if max_folds is None else min(many, max_folds)
    end = F.lit(train) + F.col("id") * step
    return spark.range(many).select(F.col("id").alias("fold"), (F.lit(0) if mode == "expanding" else end - train).cast("long").alias("train_from"), end.cast("long").alias("train_to"), (end + val).cast("long").alias("val_to"))


def fixed_starts(spark: SparkSession, starts: tuple[int, ...] = (4000, 4400, 4800, 5200, 5600), train: int = 4000, test: int = 400) -> DataFrame:
    rows = [(k, s - train, s, s + test) for k, s in enumerate(starts)]
    return spark.createDataFrame(rows, "fold long, train_from long, train_to long, val_to long")


def expanding_blocks(spark: SparkSession, n: int, splits: int = 5) -> DataFrame:
    """Equal test blocks of n // (splits + 1) at the end, each trained on all before it."""
    size = n // (splits + 1)
    first = n - splits * size
    start = F.lit(first) + F.col("id") * size
    return spark.range(splits).select(F.col("id").alias("fold"), F.lit(0).cast("long").alias("train_from"), start.cast("long").alias("train_to"), (start + size).cast("long").alias("val_to"))


def assign(df: DataFrame, folds: DataFrame, step: str = "step") -> DataFrame:
    """Rows beside each fold that they are in, with ``part`` train or val. Folds are a small fixed table, broadcast."""
    inside = (F.col(step) >= F.col("train_from")) & (F.col(step) < F.col("val_to"))
    return df.join(F.broadcast(folds), inside).withColumn("part", F.when(F.col(step) < F.col("train_to"), "train").otherwise("val"))


def counted(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))


def validation_rows(df: DataFrame, train: int, val: int, by: list[str], step: str = "step") -> DataFrame:
    """Rows of the expanding folds' validation blocks, with ``fold``: each group has as many folds as its rows have room for."""
    fold = F.floor((F.col(step) - train) / val)
    return counted(df, by).withColumn("fold", fold).filter((F.col("fold") >= 0) & (train + (F.col("fold") + 1) * val <= F.col("_n"))).drop("_n")


def block_rows(df: DataFrame, splits: int, by: list[str], step: str = "step") -> DataFrame:
    """Rows once for each of ``splits`` expanding blocks that they are in, with fold, train_to and val_to; blocks by each group's own length."""
    size = F.floor(F.col("_n") / (splits + 1))
    at = F.col("_n") - (splits - F.col("fold")) * size
    rows = counted(df, by).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long")))).withColumn("train_to", at.cast("long")).withColumn("val_to", (at + size).cast("long"))
    return rows.filter((F.col(step) < F.col("val_to")) & (F.col("val_to") > F.col("train_to"))).drop("_n")


def rolling_rows(df: DataFrame, length: int, every: int, by: list[str], step: str = "step") -> DataFrame:
    """Rows once for each window of ``length`` rows that they are in, with ``window_no``; windows begin every ``every`` rows, as many as a group has room for."""
    if min(length, every) <= 0:
        raise ValueError("length and every must be positive")
    first = F.greatest(F.floor((F.col(step) - length) / every) + 1, F.lit(0).cast("long"))
    last = F.least(F.floor(F.col(step) / every), F.floor((F.col("_n") - length) / every))
    return counted(df, by).withColumns({"_a": first, "_z": last}).filter("_z >= _a").withColumn("window_no", F.explode(F.sequence("_a", "_z"))).drop("_n", "_a", "_z")
