"""End-of-day prices: vendor rows to the canonical panel, and the policies of a price cache."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import sessions, without_sessions
from ..functions.text import vendor_field
from ..operators.panel import keep_last, require, time_range
from ..schema import FetchResult, Query, TableSchema
from .shared import checkpoint

OHLCV_TABLE = TableSchema("market.ohlcv")


def from_vendor(rows: DataFrame, columns: Sequence[str], stamp: bool = False) -> DataFrame:
    """Vendor rows (ticker, date, close, adjClose, ...) as a panel: adjusted values first, days at UTC midnight."""
    names = {}
    for c in columns:
        have = [x for x in (vendor_field(c), c) if x in rows.columns]
        if not have:
            raise KeyError(f"vendor rows have neither {vendor_field(c)} nor {c}")
        names[c] = F.coalesce(*(F.col(x).cast("double") for x in have))
    asof = F.current_timestamp() if stamp else F.lit(None).cast("timestamp")
    return rows.select(F.col("ticker").cast("string").alias("entity_id"), F.date_trunc("day", F.to_timestamp("date")).alias("ts_utc"), *(v.alias(k) for k, v in names.items()), asof.alias("asof_utc"))


def gaps(cached: DataFrame, start: str, end: str, time: str = "ts_utc") -> DataFrame:
    """The head and tail of [start, end] that the cache lacks, a row each: entity_id, gap_from, gap_to, side."""
    kind = cached.schema[time].dataType
    bounds = cached.groupBy("entity_id").agg(F.min(time).alias("first"), F.max(time).alias("last"))
    lo, hi = F.lit(start).cast(kind), F.lit(end).cast(kind)
    day = F.expr("INTERVAL 1 DAY")
    left = F.when(F.col("first") > lo, F.struct(lo.alias("gap_from"), (F.col("first") - day).alias("gap_to"), F.lit("left").alias("side")))
    right = F.when(F.col("last") < hi, F.struct((F.col("last") + day).alias("gap_from"), hi.alias("gap_to"), F.lit("right").alias("side")))
    return bounds.select("entity_id", F.explode(F.array_compact(F.array(left, right))).alias("g")).select("entity_id", "g.*")


def merge_cached(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows of both; where both have a key, the fetched one."""
    both = cached.withColumn("_new", F.lit(0)).unionByName(fetched.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, ["entity_id", "ts_utc"], "_new").drop("_new")


class CachedSource:
    """Prices through a Parquet cache in a shared folder.

    ``fetch_rows(entities, start, end)`` gives vendor rows. Policy ``use`` reads the cache where it covers the range,
    ``refresh`` always fetches, ``update`` fetches only the missing head and tail. With an ``exchange`` gaps are cut to its
    sessions, and those without one are not asked for. A fetch that fails falls back to what the cache has.
    """

    name, datasets = "eod", (OHLCV_TABLE.name,)

    def __init__(self, fetch_rows: Callable[[Sequence[str], str, str], DataFrame], folder: str, policy: str = "use", exchange: str | None = None):
        if policy not in ("use", "refresh", "update"):
            raise ValueError(f"unknown cache policy {policy!r}")
        self.fetch_rows, self.folder, self.policy, self.exchange = fetch_rows, folder.rstrip("/"), policy, exchange

    def _cached(self, spark: Any) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return spark.read.parquet(self.folder)
        except AnalysisException:
            return None

    def fetch(self, spark: Any, q: Query) -> FetchResult:
        if q.table not in self.datasets:
            raise KeyError(f"{self.name} has no table {q.table}")
        if not q.entities or q.start is None or q.end is None:
            raise ValueError("entities, start and end are required")
        OHLCV_TABLE.check(q.columns)
        cached = self._cached(spark)
        own = None if cached is None else cached.filter(F.col("entity_id").isin(list(q.entities)))
        missing = None if own is None else gaps(own, str(q.start), str(q.end))
        if missing is not None and self.exchange:
            missing = without_sessions(missing, sessions(spark, q.start, q.end, self.exchange))
        absent = list(q.entities) if own is None else sorted(set(q.entities) - {r[0] for r in own.select("entity_id").distinct().collect()})
        if self.policy == "refresh" or absent or (missing is not None and not missing.isEmpty()):
            wanted = [(e, str(q.start), str(q.end)) for e in (q.entities if self.policy != "update" or own is None else absent)]
            if self.policy == "update" and missing is not None:
                wanted += [(r["entity_id"], str(r["gap_from"])[:10], str(r["gap_to"])[:10]) for r in missing.collect()]
            fetched = None
            ranges: dict[tuple[str, str], list[str]] = {}
            for entity, start, end in wanted:
                ranges.setdefault((start, end), []).append(entity)
            for (start, end), entities in sorted(ranges.items()):  # the entities of a range are fetched side by side
                try:
                    part = from_vendor(self.fetch_rows(sorted(set(entities)), start, end), OHLCV_TABLE.canonical)
                except OSError:
                    if own is None:
                        raise
                    continue
                fetched = part if fetched is None else fetched.unionByName(part)
            if fetched is not None:
                # only the entities' partitions are written anew, from a copy that is cut from the files it replaces
                merged = fetched if own is None else checkpoint(merge_cached(own, fetched))
                merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entity_id").parquet(self.folder)
                cached = self._cached(spark)
        rows = time_range(require(cached, *q.columns).filter(F.col("entity_id").isin(list(q.entities))), q.start, q.end, q.asof)
        return FetchResult(rows.select("ts_utc", "entity_id", *q.columns, "asof_utc").orderBy("ts_utc", "entity_id"), self.name, q.table)


class ParquetPrices:
    """A store of prices for ``ChainedSource``: a Parquet folder by entity, to which rows are appended and the last fetched of a key counts."""

    def __init__(self, spark: Any, folder: str, name: str = "parquet"):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name

    def read(self, entities: Sequence[str]) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        rows = self.spark.read.parquet(self.folder)
        return keep_last(rows.filter(F.col("entity_id").isin(list(entities))), ["entity_id", "ts_utc"], "_seen").drop("_seen")

    def write(self, rows: DataFrame) -> None:
        rows.withColumn("_seen", F.current_timestamp()).write.mode("append").partitionBy("entity_id").parquet(self.folder)


class ChainedSource:
    """Prices read through several stores in order, and from the vendor at last.

    Of each store those entities are taken whose rows reach over the whole range (over its sessions, with an ``exchange``); the others go on to
    the next one. What a later store or the vendor gave is written back to the stores before it. A store that fails to read or to write is
    left out and its error kept in ``FetchResult.meta``, beside how many entities came from where. A store has a name, ``read(entities)``, which
    gives rows or None, and ``write(rows)``.
    """

    name, datasets = "eod", (OHLCV_TABLE.name,)

    def __init__(self, stores: Sequence[Any], fetch_rows: Callable[[Sequence[str], str, str], DataFrame], exchange: str | None = None):
        self.stores, self.fetch_rows, self.exchange = list(stores), fetch_rows, exchange

    def _covered(self, spark: Any, rows: DataFrame, q: Query) -> list[str]:
        lacking = gaps(rows, str(q.start), str(q.end))
        if self.exchange:
            lacking = without_sessions(lacking, sessions(spark, q.start, q.end, self.exchange))
        return sorted(r[0] for r in rows.select("entity_id").distinct().join(lacking.select("entity_id"), "entity_id", "left_anti").collect())

    def fetch(self, spark: Any, q: Query) -> FetchResult:
        if q.table not in self.datasets:
            raise KeyError(f"{self.name} has no table {q.table}")
        if not q.entities or q.start is None or q.end is None:
            raise ValueError("entities, start and end are required")
        OHLCV_TABLE.check(q.columns)
        wanted, parts = sorted(set(q.entities)), []
        errors: dict[str, str] = {}
        found: dict[str, int] = {}
        back: list[tuple[int, DataFrame]] = []  # rows and the number of stores before them
        for k, store in enumerate(self.stores):
            if not wanted:
                break
            try:
                rows = store.read(wanted)
                covered = [] if rows is None else self._covered(spark, rows, q)
            except Exception as error:  # any store, any failure: the next one is asked
                errors[store.name] = f"{type(error).__name__}: {error}"[:500]
                continue
            if covered:
                own = checkpoint(rows.filter(F.col("entity_id").isin(covered)).select("entity_id", "ts_utc", *OHLCV_TABLE.canonical, "asof_utc"))
                found[store.name] = len(covered)
                parts.append(own)
                back.append((k, own))
                wanted = [e for e in wanted if e not in set(covered)]
        if wanted:
            own = checkpoint(from_vendor(self.fetch_rows(wanted, str(q.start)[:10], str(q.end)[:10]), OHLCV_TABLE.canonical))
            found["vendor"] = len(wanted)
            parts.append(own)
            back.append((len(self.stores), own))
        for upto, own in back:
            for store in self.stores[:upto]:
                if store.name not in errors:
                    try:
                        store.write(own)
                    except Exception as error:
                        errors[store.name] = f"{type(error).__name__}: {error}"[:500]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        rows = time_range(require(every, *q.columns), q.start, q.end, q.asof)
        return FetchResult(rows.select("ts_utc", "entity_id", *q.columns, "asof_utc").orderBy("ts_utc", "entity_id"), self.name, q.table, meta={"errors": errors, "from": found})
