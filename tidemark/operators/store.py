"""Store of models, forecasts and actuals: merge by key without row-wise writes, joins, versions and the leaderboard."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import date
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from ..sources.shared import checkpoint
from . import metrics
from .commits import Files, Log, reserve
from .panel import keep_last, time_range


def merge(existing: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of theirs by key; the last of several new rows wins."""
    latest = keep_last(new, [key], *(order or ("created_utc",)))
    return existing.join(latest.select(key), key, "left_anti").select(*existing.columns).unionByName(latest.select(*existing.columns))


def forecasts_with_actuals(forecasts: DataFrame, actuals: DataFrame, ticker: str | None = None, start: Any = None, end: Any = None) -> DataFrame:
    """Inner join on (ticker, target_utc, horizon); the range reaches both scans."""
    pick = lambda df: time_range(df if ticker is None else df.filter(F.col("ticker") == ticker), start, end, time="target_utc")
    f = pick(forecasts).select("model_id", "ticker", "asof_utc", "target_utc", "horizon", "yhat")
    a = pick(actuals).select("ticker", "target_utc", "horizon", F.col("y").alias("y_actual"))
    return f.join(a, ["ticker", "target_utc", "horizon"])


def leaderboard(joined: DataFrame, window: int = 252, primary: str = "qlike") -> DataFrame:
    """Metrics of each model type on its last ``window`` targets, ranked; ties of a target by model_id."""
    typed = joined.select(text.model_type(F.col("model_id")).alias("model"), "model_id", F.col("target_utc").alias("ts_utc"), F.col("y_actual").alias("y"), "yhat")
    last = typed.withColumn("_k", F.row_number().over(W.partitionBy("model").orderBy(F.col("ts_utc").desc(), F.col("model_id").desc()))).filter(F.col("_k") <= window)
    return metrics.ranked(metrics.by_model(last, ["model"], "ts_utc", "model_id"), primary)


def report(forecasts: DataFrame, actuals: DataFrame, day: Any) -> DataFrame:
    """ticker, model, forecast, outcome and error of every forecast for one day; the day reaches both scans."""
    on = lambda df: df.filter(F.to_date("target_utc") == F.lit(str(day)[:10]).cast("date"))
    both = forecasts_with_actuals(on(forecasts), on(actuals))
    return both.select("ticker", text.model_type(F.col("model_id")).alias("model"), "yhat", "y_actual", (F.col("y_actual") - F.col("yhat")).alias("error"))


def version_report(models: DataFrame, *versions: int, model_type: str | None = None) -> DataFrame:
    rows = models.filter(F.col("version").isin(list(versions)))
    return (rows if model_type is None else rows.filter(F.col("model_type") == model_type)).select("model_type", "version", "model_id")


def next_version(models: DataFrame) -> DataFrame:
    return models.groupBy("model_type").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def latest(models: DataFrame) -> DataFrame:
    """The row of the highest version of each type."""
    return keep_last(models, ["model_type"], "version", "created_utc")


def refit_due(models: DataFrame, names: DataFrame, as_of: Column, policy: str | Callable[[Column, Column], Column] = "every_n_days", n_days: int = 30, force: bool = False) -> DataFrame:
    """Whether each of ``names(model_type)`` is to be fitted at ``as_of``: by age of its training end, always, never, or by force.

    A policy of the user's own is a function of the age in days and the model's id, both null for a model that is not there.
    """
    if not callable(policy) and policy not in ("every_n_days", "expanding_window", "always_load"):
        raise ValueError(f"unknown refit policy {policy!r}")
    known = names.join(latest(models).select("model_type", "model_id", "trained_end"), "model_type", "left")
    age = F.datediff(as_of, F.to_date("trained_end"))
    due = policy(age, F.col("model_id")) if callable(policy) else {"every_n_days": F.coalesce(age >= n_days, F.lit(True)), "expanding_window": F.lit(True), "always_load": F.col("model_id").isNull()}[policy]
    return known.select("model_type", "model_id", (F.lit(True) if force else due).alias("refit"))


def policy_for(config: dict, model: str, force: bool = False) -> dict[str, Any]:
    """force, then the model's own, then the general policy, then every 30 days."""
    if force:
        return {"force": True}
    own = config.get("models", {}).get(model, {}).get("refit_policy") or config.get("training", {}).get("refit_policy") or {}
    out = {"policy": own.get("type", "every_n_days")}
    if out["policy"] == "every_n_days":
        out["n_days"] = own.get("params", {}).get("n_days", 30)
    return out


class Store:
    """Four Parquet tables under a root that all executors share, each with a log of numbered commits (``commits.Log``), and only ever appended to.

    Forecasts and actuals are partitioned by the month of their target, models by that in which they were made, artifacts by model. A key's
    rows all lie in one partition. Reading takes the row of the highest commit of each key, so that an upsert writes its own
    rows and nothing else, and one that runs twice changes nothing. A write is one commit: readers see all of it or nothing, and a frame
    reads what its commit listed, whatever is written meanwhile. Writers at the same time lose nothing; each takes the next number.
    """

    TABLES = {"models": schema.MODELS, "forecasts": schema.FORECASTS, "actuals": schema.ACTUALS, "artifacts": schema.ARTIFACTS}
    KEYS = {"models": "model_id", "forecasts": "forecast_id", "actuals": "actual_id", "artifacts": "artifact_id"}
    #: The column whose month is the partition; tables without one of their own go by when they were created.
    TIMES = {"forecasts": "target_utc", "actuals": "target_utc"}
    #: Columns that a key decides: a filter on these lies below the choice of each key's last row, and reaches the scan.
    DECIDED = {"models": ("model_id", "model_type", "version"), "forecasts": ("model_id", "ticker", "horizon"), "actuals": ("ticker", "horizon"), "artifacts": ("model_id", "entity_id")}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self, name: str) -> Log:
        return Log(self.spark, self.root, name)

    def _exists(self, name: str) -> bool:
        return bool(self.log(name).numbers())

    def _rows(self, name: str, at: int | None = None, parts: set[str] | None = None) -> DataFrame:
        """All rows of a commit, with ``_seq``, by which they rank."""
        log = self.log(name)
        paths = log.paths(log.at(at)[1], parts)
        columns = self.TABLES[name] if name == "artifacts" else f"{self.TABLES[name]}, month date"
        if not paths:
            return self.spark.createDataFrame([], f"{columns}, _seq long")
        rows = self.spark.read.schema(f"{columns}, commit string").option("basePath", f"{self.root}/{name}").parquet(*paths)
        ranks = {path.split("/commit=")[1].split("/")[0]: seq for path, seq in paths.items()}
        rank = F.map_from_arrays(F.array(*map(F.lit, ranks)), F.array(*(F.lit(n).cast("long") for n in ranks.values())))
        return rows.withColumn("_seq", rank[F.col("commit")]).drop("commit")

    def read(self, name: str, ticker: str | None = None, start: Any = None, end: Any = None, at: int | None = None, **only: Sequence[Any]) -> DataFrame:
        """The last row of each key, of commit ``at`` or the newest. Ticker, the inclusive range of the target, and the values of columns that the key decides lie below that choice and reach the scan."""
        if unknown := set(only) - set(self.DECIDED[name]):
            raise ValueError(f"{sorted(unknown)} are not decided by the key of {name}")
        rows = self._rows(name, at)
        for column, values in (only if ticker is None else only | {"ticker": [ticker]}).items():
            rows = rows.filter(F.col(column).isin(list(values)))
        if start is not None or end is not None:
            rows = time_range(rows, start, end, time=self.TIMES[name])
            for bound, inside in ((start, F.col("month") >= F.trunc(F.to_date(F.lit(str(start))), "MM")), (end, F.col("month") <= F.to_date(F.lit(str(end))))):
                rows = rows if bound is None else rows.filter(inside)
        return keep_last(rows, [self.KEYS[name]], "_seq", "created_utc").select(*_names(self.TABLES[name]))

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"commit={uuid.uuid4().hex}"
        if name == "artifacts":
            part = "model_id"
        else:
            part, rows = "month", rows.withColumn("month", F.trunc(F.to_date(self.TIMES.get(name, "created_utc")), "MM"))
        rows.hint("rebalance", part).write.partitionBy(part).parquet(f"{self.root}/{name}/{folder}")
        return folder

    def upsert(self, name: str, rows: DataFrame) -> int | None:
        """Append the rows, the last of each key, as one commit, whose number it returns; those that are there by the same key no longer count. Without rows no commit."""
        latest = keep_last(rows, [self.KEYS[name]], "created_utc").select(*_names(self.TABLES[name]))
        return self.log(name).append(self._write(name, latest))

    def compact(self, name: str, parts: Sequence[str]) -> int | None:
        """Put one folder in place of all that these partitions (months by any of their days, models by their ids) have so far.

        What is written meanwhile stays and ranks higher. Returns the commit, or None if another compaction of them came first.
        Folders that no longer count stay for readers of earlier commits until ``vacuum``.
        """
        log = self.log(name)
        base, pieces = log.at()
        if name == "artifacts":
            wanted = {p for piece in pieces for p in piece.parts if unquote(p.removeprefix("model_id=")) in set(parts)}
        else:
            wanted = {f"month={date.fromisoformat(str(m)[:10]).replace(day=1)}" for m in parts}
        kept = keep_last(self._rows(name, base, wanted), [self.KEYS[name]], "_seq", "created_utc").select(*_names(self.TABLES[name]))
        return log.replace(base, wanted, self._write(name, kept))

    def vacuum(self, keep: int = 10) -> None:
        """Delete what only commits before the last ``keep`` of each table read."""
        for name in self.TABLES:
            self.log(name).vacuum(keep)

    def upsert_forecasts(self, rows: DataFrame) -> None:
        """Rows of model_id, ticker, asof_utc, target_utc, horizon, yhat."""
        key = text.forecast_id(*(F.col(c) for c in ("model_id", "ticker", "asof_utc", "target_utc", "horizon")))
        self.upsert("forecasts", rows.withColumns({"forecast_id": key, "created_utc": F.current_timestamp(), "meta_json": F.lit("{}")}))

    def upsert_actuals(self, rows: DataFrame) -> int:
        """Rows of ticker, target_utc, horizon, y; those whose y is not finite are left out. How many were recorded."""
        from .panel import only_finite

        key = text.actual_id(*(F.col(c) for c in ("ticker", "target_utc", "horizon")))
        finite = only_finite(rows, "y")
        self.upsert("actuals", finite.withColumns({"actual_id": key, "created_utc": F.current_timestamp(), "meta_json": F.lit("{}")}))
        return finite.count()

    def register(
        self, model_type: str, params: dict, trained_start: Any, trained_end: Any, metric: tuple[str, float] = ("", float("nan")), columns: tuple[str, ...] = (), created: Any = None, fitted: DataFrame | None = None
    ) -> str:
        """A new version of a model, with its specification, and with ``fitted(entity_id, artifact, loss, n)`` its artifacts.

        The version is taken before anything is written, and no other writer can have it; one whose writer fails stays out.
        """
        model_id, version = self.reserve(model_type)
        if fitted is not None:  # before the model's own row, so that a model that is there can be loaded
            self.add_artifacts(fitted.withColumn("model_id", F.lit(model_id)))
        self.add_models([{"model_id": model_id, "model_type": model_type, "version": version, "params": params, "trained": (trained_start, trained_end), "metric": metric, "columns": columns, "created": created, "stored": fitted is not None}])
        return model_id

    def reserve(self, model_type: str) -> tuple[str, int]:
        """The next id and version of a model, which no other writer can have."""
        known = self.read("models", model_type=[model_type]).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        version = reserve(Files(self.spark, self.root), model_type, known + 1)
        return f"{model_type}:{version:04d}", version

    def add_models(self, models: Sequence[dict[str, Any]]) -> None:
        """Rows of reserved models (model_id, model_type, version, params, trained, metric, columns, created, stored), as one commit."""
        moment = lambda t: str(t) if t else None
        rows = []
        for m in models:
            columns = m.get("columns", ())
            meta = m["params"] | ({"schema_hash": text.schema_hash(columns), "columns": list(columns)} if columns else {})
            name, value = m.get("metric", ("", float("nan")))
            rows.append((m["model_id"], m["model_type"], m["version"], moment(m.get("created")), *map(moment, m["trained"]), name, float(value), text.stable_json(meta), f"artifacts/{m['model_id']}" if m.get("stored") else ""))
        made = self.spark.createDataFrame(rows, "model_id string, model_type string, version int, created_utc string, trained_start string, trained_end string, metric_name string, metric_value double, params_json string, artifact_path string")
        times = {c: F.to_timestamp(c) for c in ("trained_start", "trained_end")} | {"created_utc": F.coalesce(F.to_timestamp("created_utc"), F.current_timestamp())}
        self.upsert("models", made.withColumns(times))

    def add_artifacts(self, fitted: DataFrame) -> None:
        """Rows of model_id, entity_id, artifact, loss, n, as one commit."""
        rows = fitted.select("model_id", F.col("entity_id").cast("string").alias("entity_id"), "artifact", F.col("loss").cast("double").alias("loss"), F.col("n").cast("long").alias("n"))
        self.upsert("artifacts", rows.withColumns({"artifact_id": F.concat_ws("|", "model_id", "entity_id"), "created_utc": F.current_timestamp()}))

    def artifacts(self, *model_ids: str) -> DataFrame:
        """(model_id, entity_id, artifact, loss, n) of these models: no other's partition is read."""
        return self.read("artifacts", model_id=model_ids).select("model_id", "entity_id", "artifact", "loss", "n")

    def model(self, model_id: str) -> dict | None:
        row = self.read("models", model_id=[model_id]).first()
        return row.asDict() if row else None

    def latest_model_id(self, model_type: str) -> str | None:
        row = self.read("models", model_type=[model_type]).orderBy(F.col("version").desc()).first()
        return row["model_id"] if row else None

    def history(self, model_type: str) -> DataFrame:
        return self.read("models", model_type=[model_type]).orderBy("version")

    def fetch_forecasts(self, ticker: str, start: Any = None, end: Any = None) -> DataFrame:
        return self.read("forecasts", ticker, start, end).orderBy("target_utc", "model_id")

    def leaderboard(self, ticker: str, as_of: str, window: int = 252, primary: str = "qlike") -> DataFrame:
        start = self.spark.sql(f"SELECT timestamp'{as_of}' - INTERVAL {int(window * 1.5)} DAYS AS s").first()["s"]
        return leaderboard(forecasts_with_actuals(self.read("forecasts", ticker, start, as_of), self.read("actuals", ticker, start, as_of)), window, primary)


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def check_columns(stored: list[str], columns: list[str]) -> None:
    """The columns at inference must be those of the fit, in their order."""
    if list(stored) != list(columns):
        raise ValueError(f"model was fitted on {len(stored)} columns {list(stored)}, got {len(columns)} columns {list(columns)}")
