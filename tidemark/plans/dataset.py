"""Declarative datasets: a specification of features and a target compiled into one lazy plan over one scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import math
from ..operators import windows
from ..schema import ParamSpec, validate


@dataclass(frozen=True)
class Feature:
    template: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class DatasetSpec:
    """Features, a target, and what becomes of rows with a missing value (``drop_if_any_nan`` or ``keep``)."""

    features: tuple[Feature, ...] = ()
    target: Feature | None = None
    start: Any = None
    end: Any = None
    entities: tuple[str, ...] | None = None
    asof: Any = None
    final_row_policy: str = "drop_if_any_nan"
    table: str = "ohlcv"


@dataclass
class Dataset:
    rows: DataFrame
    features: list[str]
    catalog: DataFrame


@dataclass(frozen=True)
class Template:
    """A named set of columns: parameters, and a function from these to {(family, transform, source column, lag): column}."""

    space: dict[str, ParamSpec]
    columns: Callable[[dict[str, Any]], dict[tuple[str, str, str, int | None], Column]]


def feature_id(table: str, family: str, transform: str, lag: int | None) -> str:
    return f"{table}_{family}_{transform}" + ("" if lag is None else f"_k{lag}")


_LAGS = {"lags": ParamSpec("int", 0, 0, 252), "price_col": ParamSpec("categorical", "close", choices=("open", "high", "low", "close"))}


def _lag_template(kind: str, family: str, transform: str) -> Template:
    return Template(_LAGS, lambda p: {(family, transform, p["price_col"], k): c for k, c in enumerate(windows.lagged(p["price_col"], p["lags"], kind).values())})


def _ranges(p: dict[str, Any]) -> dict[tuple[str, str, str, int | None], Column]:
    out = {("range", "hl", "high", None): math.log_range(F.col("high"), F.col("low"))}
    return out | ({("range", "parkinson", "high", None): math.parkinson(F.col("high"), F.col("low"))} if p["parkinson"] else {})


FEATURES: dict[str, Template] = {
    "lag_log_return": _lag_template("ret", "ret", "log"),
    "lag_abs_log_return": _lag_template("abs", "absret", "abs_log"),
    "lag_squared_log_return": _lag_template("sq", "sqret", "squared_log"),
    "offset_log_return": Template(_LAGS | {"offset": ParamSpec("int", 1, 1, 1000)}, lambda p: {("ret", "offset_log", p["price_col"], p["offset"]): windows.log_return(p["price_col"], p["offset"])}),
    "high_low_range": Template({"parkinson": ParamSpec("categorical", False, choices=(False, True))}, _ranges),
}
_SCALE = {"scale": ParamSpec("float", 1.0, 0.0), "price_col": _LAGS["price_col"]}


def _forward(p: dict[str, Any]) -> Column:
    return windows.forward_variance("_r", p["horizon"], p["annual"])


TARGETS: dict[str, tuple[dict[str, ParamSpec], Callable[[dict[str, Any]], Column]]] = {
    "next_day_squared_return": (_SCALE, lambda p: windows.next_squared_return(p["price_col"], p["scale"])),
    "forward_realized_variance": ({"horizon": ParamSpec("int", 63, 1), "annual": ParamSpec("float", 252.0, 1e-9)}, _forward),
    "parkinson": ({}, lambda p: math.parkinson(F.col("high"), F.col("low"))),
    "garman_klass": ({}, lambda p: math.garman_klass(*(F.col(c) for c in ("open", "high", "low", "close")))),
    "yang_zhang": ({}, lambda p: math.yang_zhang(*(F.col(c) for c in ("open", "high", "low", "close")), F.lag("close").over(windows.by_entity()))),
}


def build(panel: DataFrame, spec: DatasetSpec) -> Dataset:
    """entity_id, ts_utc, the features, y and ret. All templates share one window over one scan; nothing is joined.

    Range filters lie below the windows, so that the first rows of the range have no history, as at a source.
    """
    from ..operators.panel import entities_in, time_range

    if spec.target is None:
        raise ValueError("a dataset needs a target")
    rows = entities_in(time_range(panel, spec.start, spec.end, spec.asof), spec.entities)
    columns: dict[str, Column] = {}
    entries = []
    for f in spec.features:
        if f.template not in FEATURES:
            raise ValueError(f"unknown feature template {f.template!r}")
        template = FEATURES[f.template]
        params = validate(template.space, f.params)
        for (family, transform, source, lag), c in template.columns(params).items():
            name = feature_id(spec.table, family, transform, lag)
            columns[name] = c
            entries.append((name, family, transform, spec.table, source, lag or 0, f"{family}/{transform}"))
    if spec.target.template not in TARGETS:
        raise ValueError(f"unknown target template {spec.target.template!r}")
    space, target = TARGETS[spec.target.template]
    params = validate(space, spec.target.params)
    price = params.get("price_col", "close")
    rows = rows.withColumn("_r", windows.log_return(price))
    made = rows.select("entity_id", "ts_utc", *(c.alias(n) for n, c in columns.items()), target(params).alias("y"), F.col("_r").alias("ret"))
    if spec.final_row_policy == "drop_if_any_nan":
        made = made.dropna("any")
    catalog = panel.sparkSession.createDataFrame(entries, "feature_id string, family string, transform string, source_table string, source_col string, lag int, group_path string")
    return Dataset(made, list(columns), catalog)
