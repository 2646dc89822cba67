"""Normalisation, alignment, projection and scaling of panels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import at_close
from ..functions.dates import session_close_utc
from ..functions.math import finite

KEYS = ("entity_id", "ts_utc")
#: Pairs of (entity, time) columns in which a panel may come, best first. Fixed values.
KEY_PAIRS = (("series_key", "obs_date"), ("entity_id", "date"), ("entity_id", "ts_utc"), ("series_key", "ts_utc"), ("entity_id", "ts"), ("series_key", "ts"))


def infer_keys(columns: Iterable[str]) -> tuple[str, str]:
    have = set(columns)
    for entity, time in KEY_PAIRS:
        if {entity, time} <= have:
            return entity, time
    raise ValueError(f"no entity and time columns among {sorted(have)}")


def keep_last(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row a key: the last in the given order, which must be total for a deterministic result."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_last")).select(*keys, *(F.col("_last").getField(c).alias(c) for c in rest))


def time_range(df: DataFrame, start: Any = None, end: Any = None, asof: Any = None, time: str = "ts_utc") -> DataFrame:
    """Inclusive at both ends, and nothing that was not there at ``asof``; reaches the scan as pushed filters."""
    for bound, test in ((start, "ge"), (end, "le"), (asof, "le")):
        if bound is not None:
            side = F.lit(bound).cast(df.schema[time].dataType)
            df = df.filter(F.col(time) >= side if test == "ge" else F.col(time) <= side)
    return df


def entities_in(df: DataFrame, entities: Sequence[Any] | None, entity: str = "entity_id") -> DataFrame:
    return df if entities is None else df.filter(F.col(entity).cast("string").isin([str(e) for e in entities]))


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*dict.fromkeys(columns))


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}")
    return df


def normalise(df: DataFrame, columns: Sequence[str], start: Any = None, end: Any = None, entities: Sequence[Any] | None = None, asof: Any = None, order: Sequence[str] = ()) -> DataFrame:
    """A panel keyed by (entity_id, ts_utc): renamed keys, UTC time, NaN as null, filtered, one row a key, projected.

    ``order`` names the columns by which the last of rows with one key is told; without it all columns in their order.
    """
    entity, time = infer_keys(df.columns)
    require(df, *columns)
    df = df.withColumnsRenamed({entity: "entity_id", time: "ts_utc"}).withColumn("entity_id", F.col("entity_id").cast("string"))
    if dict(df.dtypes)["ts_utc"] not in ("timestamp", "timestamp_ntz"):
        df = df.withColumn("ts_utc", F.to_timestamp("ts_utc"))
    if "asof_utc" not in df.columns:
        df = df.withColumn("asof_utc", F.lit(None).cast("timestamp"))
    df = entities_in(time_range(df, start, end, asof), entities)
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})
    keep = [c for c in dict.fromkeys([*columns, "asof_utc"]) if c not in KEYS]
    ranks = list(order) or [c for c in df.columns if c not in KEYS]
    return keep_last(df.select(*KEYS, *dict.fromkeys([*keep, *ranks])), KEYS, *ranks).select(*KEYS, *keep)


def parse_grid(grid: str | None) -> str:
    """The calendar of ``X:CAL``; XNYS where none is named."""
    return grid.split(":", 1)[1] if grid and ":" in grid else "XNYS"


#: Zone and closing hour of an exchange's sessions. Fixed values.
CALENDARS = {"XNYS": ("America/New_York", 16), "XNAS": ("America/New_York", 16), "XTSE": ("America/Toronto", 16), "XTKS": ("Asia/Tokyo", 15), "XHKG": ("Asia/Hong_Kong", 16), "XETR": ("Europe/Berlin", 17)}


def sessionise(df: DataFrame, time: str = "ts_utc", grid: str | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Each day at the instant of its session's close on the grid's exchange, every day alike; or each time at the next close of the table ``sessions``, which knows holidays and early closes."""
    if sessions is not None:
        return at_close(df, sessions, time)
    calendar = parse_grid(grid)
    if calendar not in CALENDARS:
        raise ValueError(f"unknown calendar {calendar!r}; there are {sorted(CALENDARS)}")
    return df.withColumn(time, session_close_utc(F.to_date(time), *CALENDARS[calendar]))


def canonical_index(df: DataFrame, date_col: str = "date", order: Sequence[str] = ()) -> DataFrame:
    """One row a naive timestamp, the last by ``order`` (all columns by default)."""
    df = df.withColumn(date_col, F.to_timestamp(date_col).cast("timestamp_ntz"))
    return keep_last(df, [date_col], *(order or [c for c in df.columns if c != date_col]))


def canonical_ohlcv(df: DataFrame, required: Sequence[str] = ("open", "high", "low", "close", "volume"), allow_extra: bool = False) -> DataFrame:
    require(df, *required)
    return df if allow_extra else df.select(*[c for c in df.columns if c in (*KEYS, "date", *required)])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def cross_section(df: DataFrame, entity: str) -> DataFrame:
    return df.filter(F.col("entity_id") == entity).drop("entity_id")


def add_const(df: DataFrame) -> DataFrame:
    return df if "const" in df.columns else df.withColumn("const", F.lit(1.0))


def drop_any_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def to_steps(df: DataFrame, by: Sequence[str] = ("entity_id",), time: str = "ts_utc") -> DataFrame:
    """``step``: the place of a row in its entity's time order, from 0."""
    return df.withColumn("step", (F.row_number().over(W.partitionBy(*by).orderBy(time)) - 1).cast("long"))


def prepare(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return add_const(df.select(*KEYS, *(F.col(c).cast("double").alias(c) for c in columns if c not in KEYS)))


def feature_group(column: str) -> str:
    """abs, sq or raw, by the column's name."""
    name = column.lower()
    return "abs" if "abs" in name else "sq" if "sq" in name else "raw"


#: What a letter group at the end of a variant's name stands for. Fixed values.
LETTERS = {"E": "raw", "AE": "abs", "SE": "sq"}


def variant_groups(variant: str) -> set[str]:
    """ES uses no feature; STES_ and letter groups use those; boosted variants and other names use all."""
    if variant == "ES":
        return set()
    found = re.fullmatch(r"STES_((?:AE|SE|E)+)", variant)
    return {LETTERS[x] for x in re.findall("AE|SE|E", found[1])} if found else set(LETTERS.values())


def variant_columns(columns: Sequence[str], variant: str, groups: Mapping[str, Iterable[str]] | None = None) -> list[str]:
    """The columns that a variant uses, the constant first."""
    wanted = set(groups[variant]) if groups and variant in groups else variant_groups(variant)
    const = ["const"] if "const" in columns else []
    return const + [c for c in columns if c != "const" and feature_group(c) in wanted]


def positional_split(df: DataFrame, oos_start: Any, burn_in: int = 0) -> DataFrame:
    """One row an entity: burn_in (held below the end), train_end = all rows, oos_start = rows before the date, oos_end."""
    counts = df.groupBy("entity_id").agg(F.count("*").alias("oos_end"), F.count_if(F.col("ts_utc") < F.lit(oos_start).cast(df.schema["ts_utc"].dataType)).alias("oos_start"))
    return counts.select("entity_id", F.least(F.lit(burn_in).cast("long"), F.col("oos_end")).alias("burn_in"), F.col("oos_end").alias("train_end"), "oos_start", "oos_end")


def standardise(df: DataFrame, columns: Sequence[str], train: Column, skip: Sequence[str] = ("const",), skip_prefix: str = "sig.") -> DataFrame:
    """(x - mean) / population deviation of the training rows of the entity; a zero deviation counts as 1.

    One aggregate row an entity comes back to the rows as a window over the same partitioning: no join.
    """
    w = W.partitionBy("entity_id")
    out = {}
    for c in columns:
        if c in skip or c.startswith(skip_prefix):
            continue
        seen = F.when(train, F.col(f"`{c}`"))
        scale = F.stddev_pop(seen).over(w)
        out[c] = (F.col(f"`{c}`") - F.avg(seen).over(w)) / F.when(scale > 0, scale).otherwise(1.0)
    return df.withColumns(out)


def scale_up(df: DataFrame, returns: str = "ret", target: str = "y", factor: float = 100.0) -> DataFrame:
    return df.withColumns({returns: F.col(returns) * factor, target: F.col(target) * factor * factor})


def scale_down(df: DataFrame, *forecasts: str, factor: float = 100.0) -> DataFrame:
    return df.withColumns({c: F.col(c) / (factor * factor) for c in forecasts})


def fill_warm_up(baseline: DataFrame, signatures: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All baseline rows; the signature columns are 0 where their own rows have not begun."""
    return baseline.join(signatures.select(*KEYS, *columns), list(KEYS), "left").fillna(0.0, subset=list(columns))


def only_finite(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.filter(finite(F.col(c)))
    return df


def lead_with_edge(column: str, by: Sequence[str] = ("entity_id",), time: str = "ts_utc") -> Column:
    """The next value; the last repeats itself."""
    return F.coalesce(F.lead(column).over(W.partitionBy(*by).orderBy(time)), F.col(column))


def coverage(df: DataFrame, time: str = "ts_utc") -> DataFrame:
    return df.groupBy("entity_id").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))


def assert_coverage(df: DataFrame, start: Any, end: Any, time: str = "ts_utc", slack: int = 3) -> None:
    """An error that names the entities whose rows do not reach from the first to the last business day of the range, ``slack`` business days aside."""
    import numpy as np

    first = str(np.busday_offset(np.datetime64(str(start)[:10]), slack, "forward"))
    last = str(np.busday_offset(np.datetime64(str(end)[:10]), -slack, "backward"))
    short = coverage(df, time).filter((F.to_date("first") > F.lit(first).cast("date")) | (F.to_date("last") < F.lit(last).cast("date")))
    if named := [r["entity_id"] for r in short.select("entity_id").orderBy("entity_id").limit(20).collect()]:
        raise ValueError(f"rows of {named} do not cover {first} to {last}")


def members(df: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are among those of ``wanted``."""
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def pivot_field(df: DataFrame, field: str, entities: Sequence[str], time: str = "ts_utc") -> DataFrame:
    """The wide matrix of one field: a row a time, a column an entity of the given list (never found by a scan)."""
    return df.groupBy(time).pivot("entity_id", list(entities)).agg(F.first(field))
