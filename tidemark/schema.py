"""Fixed table schemas, parameter specifications and query descriptions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

OHLCV = ("open", "high", "low", "close", "volume")
OHLCV_SCHEMA = T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("ts_utc", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in OHLCV)])
MODELS = "model_id string, model_type string, version int, created_utc timestamp, trained_start timestamp, trained_end timestamp, metric_name string, metric_value double, params_json string, artifact_path string"
FORECASTS = "forecast_id string, model_id string, ticker string, asof_utc timestamp, target_utc timestamp, horizon int, yhat double, created_utc timestamp, meta_json string"
ACTUALS = "actual_id string, ticker string, target_utc timestamp, horizon int, y double, created_utc timestamp, meta_json string"
#: Fitted parameters, a row a model and series: a pickled ``fanout.Fitted``. Read only stores that you trust.
ARTIFACTS = "artifact_id string, model_id string, entity_id string, artifact binary, loss double, n long, created_utc timestamp"


@dataclass(frozen=True)
class TableSchema:
    """What a source declares of a table: required and canonical columns, keys and cadence."""

    name: str
    required: tuple[str, ...] = OHLCV
    canonical: tuple[str, ...] = OHLCV
    entity: str = "entity_id"
    time: str = "ts_utc"
    freq: str = "B"
    cadence_days: int = 1

    def check(self, columns: Sequence[str]) -> None:
        unknown = [c for c in columns if c not in self.canonical]
        if unknown:
            raise ValueError(f"{self.name} has no columns {unknown}")


@dataclass(frozen=True)
class Query:
    """A scan: projection, inclusive time range, entities, point in time, and a calendar grid such as ``sessions:XNYS``."""

    table: str
    columns: tuple[str, ...]
    start: Any = None
    end: Any = None
    entities: tuple[str, ...] | None = None
    asof: Any = None
    grid: str | None = None


@dataclass
class FetchResult:
    data: DataFrame
    source: str
    dataset: str
    is_pit: bool = False
    meta: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class ParamSpec:
    """The type, default and range or choices of a template's parameter."""

    type: str
    default: Any = None
    low: float | None = None
    high: float | None = None
    choices: tuple[Any, ...] | None = None

    def check(self, name: str, value: Any) -> Any:
        value = self.default if value is None else value
        if self.type == "int":
            value = int(value)
        elif self.type == "float":
            value = float(value)
        if self.choices is not None and value not in self.choices:
            raise ValueError(f"{name}={value!r} is not one of {list(self.choices)}")
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ValueError(f"{name}={value!r} is outside [{self.low}, {self.high}]")
        return value


def validate(space: dict[str, ParamSpec], params: dict[str, Any]) -> dict[str, Any]:
    unknown = set(params) - set(space)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    return {k: spec.check(k, params.get(k)) for k, spec in space.items()}


class DataBundle(dict):
    """Named tables, with a clear error for one that is absent."""

    def require(self, *names: str) -> None:
        missing = [n for n in names if n not in self]
        if missing:
            raise KeyError(f"bundle has no tables {missing}")
