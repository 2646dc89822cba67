"""Recursions over series too long for one task: blocks of rows become maps of the state, maps are chained, and a second pass fills in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import checkpoint

#: Numbers of a state, or of what a block does to it.
Numbers = np.ndarray


@dataclass
class Scan:
    """A recursion of which a block of rows can be told by a few numbers.

    ``describe`` makes these of a block's rows in order, ``advance(state, numbers)`` is the state behind the block, ``start`` the state
    before a series' first row, from the first ``head_rows`` values that ``head`` gives of its rows, and ``fill`` the
    outputs of a block from the state before it.
    """

    describe: Callable[[pd.DataFrame], Numbers]
    advance: Callable[[Numbers, Numbers], Numbers]
    start: Callable[[Numbers], Numbers]
    fill: Callable[[pd.DataFrame, Numbers], dict[str, np.ndarray]]
    head: Callable[[pd.DataFrame], Numbers]
    head_rows: int = 1


def composed(a: Numbers, b: Numbers, floor: Numbers | None = None) -> Numbers:
    """(a, b, floor) of x -> max(a_n (... max(a_1 x + b_1, floor_1) ...) + b_n, floor_n), by composing neighbours, again and again.

    With floors the slopes must not be negative: then max(a x + b, c) behind max(a' x + b', c') is a map of the same kind.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    c = np.full(len(a), -np.inf) if floor is None else np.broadcast_to(np.asarray(floor, float), len(a))
    if floor is not None and (a < 0).any():
        raise ValueError("a recursion with a floor cannot be cut into blocks where a slope is negative")
    while len(a) > 1:
        if len(a) % 2:
            a, b, c = np.append(a, 1.0), np.append(b, 0.0), np.append(c, -np.inf)
        first, then = slice(0, None, 2), slice(1, None, 2)
        low = np.where(c[first] == -np.inf, -np.inf, a[then] * np.where(c[first] == -np.inf, 0.0, c[first]) + b[then])
        a, b, c = a[then] * a[first], a[then] * b[first] + b[then], np.maximum(low, c[then])
    return np.array([a[0], b[0], c[0]]) if len(a) else np.array([1.0, 0.0, -np.inf])


def affine(maps: Callable[[pd.DataFrame], tuple], start: Callable[[Numbers], float], head: Callable[[pd.DataFrame], Numbers], fill: Callable[[pd.DataFrame, float], dict[str, np.ndarray]], head_rows: int = 1) -> Scan:
    """The scan of one state by v' = max(a v + b, floor); ``maps`` gives a, b and, if there is one, the floor of each row."""
    return Scan(
        lambda g: composed(*maps(g)),
        lambda v, m: np.maximum(m[0] * v + m[1], m[2]),
        lambda h: np.array([start(h)]), lambda g, v: fill(g, float(v[0])), head, head_rows,
    )


def blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """``df`` with ``_at``, which grows with (by, order), and ``_block``: at most ``rows`` (rounded up to a power of two) consecutive rows share one.

    Rows are dealt by ranges of (by, order), so that a long series lies in many partitions; a row's place in its sorted
    partition numbers it. No row sees a window over its series. Written once, so that both passes see the same blocks.
    """
    bits = max(1, (rows - 1).bit_length())
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    return checkpoint(dealt.withColumn("_block", F.shiftright("_at", bits)))


def scan_by(df: DataFrame, scan: Scan, outputs: Sequence[str], by: Sequence[str] = ("entity_id",), order: Sequence[str] = ("ts_utc",), rows: int = 1 << 16, reverse: bool = False) -> DataFrame:
    """``df`` with double columns ``outputs`` of the recursion in the order of each series, or from behind; NaN comes back as null.

    First pass: each (series, block) is one row of numbers and its first values. These are chained a series: a group there has a row a block.
    Second pass: each (series, block) meets the state before it. No group of rows is larger than a block, whatever the series.
    """
    key, kinds = [*by, "_block"], {f.name: f.dataType for f in df.schema.fields}
    cut = blocks(df, by, order, rows)
    ids = [T.StructField(c, kinds[c]) for c in by] + [T.StructField("_block", T.LongType())]
    numbers = T.ArrayType(T.DoubleType())
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in outputs]

    def ordered(group: pd.DataFrame) -> pd.DataFrame:
        return group.sort_values("_at", ascending=not reverse, ignore_index=True)

    def describe(group: pd.DataFrame) -> pd.DataFrame:
        group = ordered(group)
        return group[key].head(1).assign(does=[scan.describe(group)], head=[np.asarray(scan.head(group), float)[: scan.head_rows]])

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_block", ascending=not reverse, ignore_index=True)
        first: list[float] = []
        for h in group["head"]:
            first += list(h[: scan.head_rows - len(first)])
            if len(first) >= scan.head_rows:
                break
        state, states = np.asarray(scan.start(np.array(first, float)), float), []
        for does in group["does"]:
            states.append(state)
            state = scan.advance(state, np.asarray(does, float))
        return group[key].assign(state=states)

    schema = T.StructType([f for f in df.schema.fields if f.name not in outputs] + [T.StructField(c, T.DoubleType()) for c in outputs])

    def fill(group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        group = ordered(group)
        return group.assign(**scan.fill(group, np.asarray(before["state"].iloc[0], float)))[schema.names]

    told = cut.groupBy(*key).applyInPandas(describe, T.StructType([*ids, T.StructField("does", numbers), T.StructField("head", numbers)]))
    states = told.groupBy(*by).applyInPandas(chain, T.StructType([*ids, T.StructField("state", numbers)]))
    out = cut.groupBy(*key).cogroup(states.groupBy(*key)).applyInPandas(fill, schema)
    return out.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in [*outputs, *plain]})
