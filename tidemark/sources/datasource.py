"""Sources and generators that Spark itself can name: Python data sources, one partition an entity, and table functions."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VALUES = ("open", "high", "low", "close", "volume", "adjOpen", "adjHigh", "adjLow", "adjClose", "adjVolume")
VENDOR = "ticker string, date string, " + ", ".join(f"{c} double" for c in VALUES)


class Entity(InputPartition):
    """One entity's rows are one task's work."""


class _VendorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        missing = [k for k in ("url", "entities", "start", "end") if not options.get(k)]
        if missing:
            raise ValueError(f"options {missing} are required")
        self.options = dict(options)

    def partitions(self) -> Sequence[InputPartition]:
        return [Entity(e.strip()) for e in self.options["entities"].split(",") if e.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        request = urllib.request.Request(o["url"].format(entity=partition.value, start=o["start"], end=o["end"]))
        if o.get("token"):
            request.add_header("Authorization", f"Token {o['token']}")
        for attempt in range(int(o.get("retries", "3"))):
            try:
                with urllib.request.urlopen(request, timeout=float(o.get("timeout", "30"))) as answer:
                    rows = json.load(answer)
                break
            except OSError:
                if attempt + 1 == int(o.get("retries", "3")):
                    raise
                time.sleep(2.0**attempt)
        for row in rows:
            yield (partition.value, str(row["date"])[:10], *(None if row.get(c) is None else float(row[c]) for c in VALUES))


class VendorDataSource(DataSource):
    """End-of-day rows of a vendor that answers ``url`` (with {entity}, {start} and {end}) by a JSON list; entities are read side by side."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_eod"

    def schema(self) -> str:
        return VENDOR

    def reader(self, schema: Any) -> DataSourceReader:
        return _VendorReader(self.options)


class _SimulatedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> Sequence[InputPartition]:
        return [Entity(int(s)) for s in self.options.get("seeds", "1").split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from .simulated import path

        r, s2 = path(int(self.options.get("n", "2500")), partition.value, **{k: float(self.options[k]) for k in ("mu", "omega", "alpha", "beta", "eta") if k in self.options})
        for step, (a, b) in enumerate(zip(r.tolist(), s2.tolist(), strict=True)):
            yield f"SIM{partition.value}", step, a, b


class SimulatedDataSource(DataSource):
    """Returns and variances of simulated series, one partition a seed."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_garch"

    def schema(self) -> str:
        return "entity_id string, step long, ret double, sigma2 double"

    def reader(self, schema: Any) -> DataSourceReader:
        return _SimulatedReader(self.options)


@F.udtf(returnType="day date")
class BusinessDays:
    """business_days(start, end): the weekdays of the inclusive range."""

    def eval(self, start: date, end: date) -> Iterator[tuple[date]]:
        day = start
        while day is not None and end is not None and day <= end:
            if day.weekday() < 5:
                yield (day,)
            day += timedelta(days=1)


@F.udtf(returnType="fold bigint, train_from bigint, train_to bigint, val_to bigint")
class Folds:
    """expanding_folds(n, train, val): half-open steps of folds whose validation follows training at once."""

    def eval(self, n: int, train: int, val: int) -> Iterator[tuple[int, int, int, int]]:
        fold = 0
        while val > 0 and train + (fold + 1) * val <= n:
            yield fold, 0, train + fold * val, train + (fold + 1) * val
            fold += 1


def register(spark: SparkSession) -> None:
    """Make the sources and table functions known to a session, also in SQL."""
    spark.dataSource.register(VendorDataSource)
    spark.dataSource.register(SimulatedDataSource)
    spark.udtf.register("business_days", BusinessDays)
    spark.udtf.register("expanding_folds", Folds)


def vendor_rows(spark: SparkSession, url: str, **options: str) -> Callable[[Sequence[str], str, str], DataFrame]:
    """What ``eod.CachedSource`` fetches by."""
    spark.dataSource.register(VendorDataSource)

    def fetch(entities: Sequence[str], start: str, end: str) -> DataFrame:
        return spark.read.format("tidemark_eod").options(url=url, entities=",".join(entities), start=start, end=end, **options).load()

    return fetch
