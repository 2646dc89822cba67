"""Sources by name: the first that has a table answers; errors of those before it are told if none does."""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from ..operators.panel import normalise
from ..schema import FetchResult, Query


class Source(Protocol):
    name: str
    datasets: tuple[str, ...]

    def fetch(self, spark: SparkSession, q: Query) -> FetchResult: ...


class ParquetSource:
    """Tables of a folder, a Parquet folder or file each; filters and columns reach the scan."""

    def __init__(self, folder: str, name: str = "parquet", datasets: tuple[str, ...] = ("market.ohlcv",)):
        self.folder, self.name, self.datasets = folder.rstrip("/"), name, datasets

    def fetch(self, spark: SparkSession, q: Query) -> FetchResult:
        rows = spark.read.parquet(f"{self.folder}/{q.table}")
        return FetchResult(normalise(rows, q.columns, q.start, q.end, q.entities, q.asof), self.name, q.table)


class FrameSource:
    """Tables that a caller already has as frames."""

    def __init__(self, frames: dict[str, DataFrame], name: str = "frames"):
        self.frames, self.name, self.datasets = frames, name, tuple(frames)

    def fetch(self, spark: SparkSession, q: Query) -> FetchResult:
        return FetchResult(normalise(self.frames[q.table], q.columns, q.start, q.end, q.entities, q.asof), self.name, q.table)


class JdbcSource:
    """A table of a database over JDBC, read in parallel by a numeric or date column where one is named."""

    def __init__(self, url: str, table: str = "price_volume_data", name: str = "jdbc", dataset: str = "market.ohlcv", **options: str):
        self.url, self.table, self.name, self.datasets, self.options = url, table, name, (dataset,), options

    def fetch(self, spark: SparkSession, q: Query) -> FetchResult:
        rows = spark.read.format("jdbc").options(url=self.url, dbtable=self.table, **self.options).load()
        return FetchResult(normalise(rows, q.columns, q.start, q.end, q.entities, q.asof), self.name, q.table)

    def append(self, rows: DataFrame) -> None:
        """Adjusted values that are missing take the raw ones."""
        from pyspark.sql import functions as F

        raw = {"adjOpen": "open", "adjHigh": "high", "adjLow": "low", "adjClose": "close", "adjVolume": "volume"}
        rows = rows.withColumns({a: F.coalesce(a, c) if a in rows.columns else F.col(c) for a, c in raw.items() if c in rows.columns})
        rows.write.format("jdbc").options(url=self.url, dbtable=self.table, **self.options).mode("append").save()


class Registry:
    def __init__(self, spark: SparkSession, *sources: Source, defaults: dict[str, str] | None = None):
        self.spark, self.sources, self.defaults = spark, {s.name: s for s in sources}, defaults or {}

    def load(self, q: Query, source: str | None = None) -> FetchResult:
        wanted = source or self.defaults.get(q.table)
        names = [wanted] if wanted else [n for n, s in self.sources.items() if q.table in s.datasets]
        failures: list[str] = []
        for name in names:
            if name not in self.sources:
                raise KeyError(f"no source {name!r}; there are {sorted(self.sources)}")
            try:
                return self.sources[name].fetch(self.spark, q)
            except (KeyError, ValueError, OSError) as e:
                failures.append(f"{name}: {e}")
        raise LookupError(f"no source gave {q.table}: {'; '.join(failures) or 'none has it'}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, renames: dict[str, str] | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    rows = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return rows.withColumnsRenamed(renames or {})


def load_any(spark: SparkSession, path: str, kind: str = "parquet", **options: Any) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def load_snapshot(spark: SparkSession, path: str, train_to: int, target: str = "y", factor: float = 100.0) -> dict[str, DataFrame]:
    """Of a stored dataset (entity_id, ts_utc, ..., y): all rows and the first ``train_to`` of each entity, each also with the target scaled."""
    from pyspark.sql import functions as F

    from ..operators.panel import to_steps

    every = to_steps(spark.read.parquet(path)).withColumn(f"{target}_scaled", F.col(target) * factor * factor)
    return {"all": every, "train": every.filter(F.col("step") < train_to)}
