"""Identifiers, parsed lists and formats."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

BAR = chr(124)


def model_type(model_id: Column) -> Column:
    return F.substring_index(model_id, ":", 1)


def version_id(kind: Column, version: Column) -> Column:
    digits = version.cast("string")
    return F.concat_ws(":", kind, F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0")))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def forecast_id(model_id: Column, ticker: Column, asof: Column, target: Column, horizon: Column) -> Column:
    return F.concat_ws(BAR, model_id, ticker, stamp(asof), stamp(target), F.concat(F.lit("h"), horizon.cast("string")))


def actual_id(ticker: Column, target: Column, horizon: Column) -> Column:
    return F.concat_ws(BAR, ticker, stamp(target), F.concat(F.lit("h"), horizon.cast("string")))


def vendor_field(name: str) -> str:
    return "adj" + name[:1].upper() + name[1:]


def schema_hash(columns: Sequence[str]) -> str:
    return hashlib.sha256(json.dumps(list(columns)).encode()).hexdigest()[:16]


def stable_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, default=str)


AUGMENTATIONS = ("basepoint", "addtime", "leadlag", "ir", "cumsum")


def augmentations(spec: str | Sequence[str] | None) -> list[str]:
    """Ordered, distinct augmentations of ``a,b``, ``a+b``, ``a->b``, a list, ``all`` or ``none``; ``time`` is addtime."""
    items = re.split(r"\s*(?:,|\+|->)\s*", spec.strip().lower()) if isinstance(spec, str) else [str(x).lower() for x in spec or []]
    items = ["addtime" if x == "time" else x for x in items if x not in ("", "none")]
    if items == ["all"]:
        items = ["cumsum", "basepoint", "addtime", "leadlag"]
    unknown = [x for x in items if x not in AUGMENTATIONS]
    if unknown:
        raise ValueError(f"unknown augmentations {unknown}")
    return list(dict.fromkeys(items))


def half_lives(spec: str | Sequence[float]) -> list[float]:
    values = [float(x) for x in (re.split(r"[,+\s]+", spec.strip()) if isinstance(spec, str) else spec)]
    if not values or min(values) <= 0:
        raise ValueError("half-lives must be positive")
    return list(dict.fromkeys(values))


def scientific(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}e", x)


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%"))


def markdown(columns: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    line = lambda cells: f"{BAR} " + f" {BAR} ".join(map(str, cells)) + f" {BAR}"
    return "\n".join([line(columns), line(["---"] * len(columns)), *map(line, rows)]) + "\n"
