"""Exact quantiles of a whole column by nested histograms: no task and no driver holds the column's values."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


@dataclass
class Range:
    """Finite values from ``low`` to ``high``, both there, ``below`` others before them; of which the ``ranks`` are wanted."""

    low: float
    high: float
    below: int
    many: int
    ranks: list[int]
    #: Most values of the range before lay in this one: they are counted by the magnitude of their distance to ``low`` next.
    lopsided: bool = False

    def holds(self) -> Column:
        return (F.col("x") >= self.low) & (F.col("x") <= self.high)

    def bucket(self) -> Column:
        """A number below BUCKETS that grows with the value; that of ``low`` is 0 and that of ``high`` another."""
        half = 1.0 if math.isfinite(self.high - self.low) else 0.5  # so that no difference overflows
        gap, whole = F.col("x") * half - self.low * half, self.high * half - self.low * half
        if not self.lopsided:
            return F.least(F.floor(gap / whole * BUCKETS), F.lit(BUCKETS - 1))
        depth = F.floor((F.log2(gap) - math.log2(whole)) * 2) + BUCKETS - 1  # half octaves down from the width
        return F.when(gap > 0, F.greatest(F.lit(1), F.least(depth, F.lit(BUCKETS - 1)))).otherwise(F.lit(0))


def between(a: float, b: float, share: float) -> float:
    """The point at ``share`` of the way from a to b; of an infinite end that end, NaN between two different ones."""
    if a == b or share == 0:
        return a
    if math.isinf(a) or math.isinf(b):
        return a + b
    return a + (b - a) * share if math.isfinite(b - a) else a * (1 - share) + b * share


def exact(df: DataFrame, value: str, shares: Sequence[float], few: int = 10_000) -> list[float]:
    """The linearly interpolated quantiles of the values that are neither null nor NaN; empty for none.

    Infinite values are counted apart: they take the first and last ranks. A histogram of BUCKETS ranges says which of them holds each wanted
    rank; those ranges alone are counted again, each by as many, until a range has one value or all that are left
    have at most ``few`` each, which are then sorted. Ranges are of equal width, or, where most values fell into one of these, of equal
    steps of magnitude from its low end on. Both ends of a range fall into different buckets, so that each round takes values out of it and the
    rounds end. What the driver sees is bounded by the number of shares.
    """
    rows = df.select(F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)").persist()
    try:
        inside = F.when(F.abs("x") < math.inf, F.col("x"))
        n, under, finite, low, high = rows.agg(F.count("x"), F.count_if(F.col("x") == -math.inf), F.count(inside), F.min(inside), F.max(inside)).first()
        if not n:
            return []
        wanted = sorted({k for p in shares for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
        found = {k: -math.inf if k < under else math.inf for k in wanted}
        ranks = [k for k in wanted if under <= k < under + finite]
        todo, sort = [Range(low, high, under, finite, ranks)] if ranks else [], []
        while todo:
            for t in todo:
                if t.low == t.high:
                    found |= dict.fromkeys(t.ranks, t.low)
            sort += [t for t in todo if t.low < t.high and t.many <= few]
            todo = [t for t in todo if t.low < t.high and t.many > few]
            if not todo:
                break
            spot = F.when(F.lit(False), F.lit(0).cast("long"))
            for i, t in enumerate(todo):
                spot = spot.when(t.holds(), t.bucket() + i * BUCKETS)
            counts = rows.groupBy(spot.alias("b")).agg(F.count("x").alias("n"), F.min("x").alias("a"), F.max("x").alias("z")).filter("b is not null").collect()
            fresh = []
            for i, t in enumerate(todo):
                below = t.below
                for r in sorted((r for r in counts if r["b"] // BUCKETS == i), key=lambda r: r["b"]):
                    if held := [k for k in t.ranks if below <= k < below + r["n"]]:
                        fresh.append(Range(r["a"], r["z"], below, r["n"], held, lopsided=not t.lopsided and 2 * r["n"] > t.many))
                    below += r["n"]
            todo = fresh
        if sort:
            any_of = sort[0].holds()
            for t in sort[1:]:
                any_of = any_of | t.holds()
            values = sorted(r["x"] for r in rows.filter(any_of).collect())
            for t in sort:
                own = [x for x in values if t.low <= x <= t.high]
                found |= {k: own[k - t.below] for k in t.ranks}
    finally:
        rows.unpersist()
    return [between(found[math.floor(p * (n - 1))], found[math.ceil(p * (n - 1))], p * (n - 1) - math.floor(p * (n - 1))) for p in shares]
