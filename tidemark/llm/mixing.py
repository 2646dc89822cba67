"""Mixing sources to target weights by nested hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, word_count

#: A table of limits with so many sources at most is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def prefixed(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with _rank, a row's place in the order from 0, and for each of ``sums`` (name, column) the sum over the rows before it.

    Rows are dealt by ranges of the order; each range counts for itself, and begins at the sums of the ranges before, a row a range.
    """
    ranged = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranges = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_rank_0"), *(F.sum(c).alias(f"{name}_0") for name, c in sums.items()))
    starts = totals.select("_range", *(F.coalesce(F.sum(c).over(ranges), F.lit(0)).alias(c) for c in ["_rank_0", *(f"{name}_0" for name in sums)]))
    inside = ranged.withColumns({"_rank": F.count("*").over(before), **{name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()}})
    both = inside.join(F.broadcast(starts), "_range")
    return both.select(*df.columns, *((F.col(c) + F.col(f"{c}_0")).alias(c) for c in ["_rank", *sums]))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of (no_source, src, source_size) rows, one a source.

    Sources in code-point order, null last, take the weights in turn. A target stops at ``most`` times its source's
    size; the excess goes to the others by weight until none is above. In ascending order of the weight at which a
    source stops, that is a running sum. No task holds all sources (``prefixed``).
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = prefixed(sizes, ["no_source", "src"], {}).withColumn("weight", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int"))).drop("_rank")
    ranked = ranked.withColumn("stops_at", F.lit(most) * F.col("source_size") / F.col("weight"))
    filled = prefixed(ranked, ["stops_at", "no_source", "src"], {"_size": "source_size", "_weight": "weight"})
    total = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    level = (share * F.lit(total["size"]) - most * F.col("_size")) / (F.lit(total["weight"]) - F.col("_weight"))
    levelled = filled.withColumn("level", level).withColumn("full", F.col("stops_at") <= F.col("level"))
    common = levelled.agg(F.min(F.when(~F.col("full"), F.struct("stops_at", "no_source", "src", "level"))).alias("c")).first()["c"]
    target = F.when(F.col("full"), F.lit(most) * F.col("source_size")).otherwise(F.col("weight") * (0.0 if common is None else common["level"]))
    return levelled.select("no_source", "src", "source_size", target.alias("target"))


BY = ["no_source", "src"]


def _keyed(docs: DataFrame, seed: str) -> dict[str, F.Column]:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))))
    return {
        "no_source": F.col("source").isNull(),
        "src": F.coalesce("source", F.lit("")),
        "size": word_count(F.col("text")),
        "h": F.conv(F.substring(key, 1, 15), 16, 10).cast("long"),
    }


def source_limits(base: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Of each source of ``base(no_source, src, size, h)``: source_size, target, how often all its rows are in, and the last hash in once more."""
    coarse = base.groupBy(*BY, F.shiftright("h", 48).alias("b1")).agg(F.sum("size").alias("words"))
    coarse = checkpoint(coarse)
    targets = source_targets(coarse.groupBy(*BY).agg(F.sum("words").alias("source_size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = checkpoint(targets.withColumn("whole", F.least(F.floor(ratio), F.lit(int(most)))).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))

    def boundary(histogram: DataFrame, bounds: DataFrame, bucket: str) -> DataFrame:
        """For each source the first bucket in which the running sum reaches the rest, and what is left of the rest there."""
        w = W.partitionBy(*BY).orderBy(bucket)
        run = histogram.join(bounds, BY).withColumn("upto", F.sum("words").over(w))
        met = run.filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        return met.select(*BY, bucket, (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), "words")

    first = checkpoint(boundary(coarse, targets.select(*BY, "rest"), "b1").drop("words"))
    inner = base.withColumn("b1", F.shiftright("h", 48)).withColumn("b2", F.shiftright("h", 36).bitwiseAND(4095)).join(first.drop("rest"), [*BY, "b1"])
    second = checkpoint(boundary(inner.groupBy(*BY, "b2").agg(F.sum("size").alias("words")), first.drop("b1"), "b2").drop("words"))
    last = inner.join(second.drop("rest"), [*BY, "b2"]).groupBy(*BY, "h").agg(F.sum("size").alias("words"))
    edge = boundary(last, second.drop("b2"), "h")
    edge = edge.select(*BY, F.when(F.col("words") - F.col("rest") <= F.col("rest"), F.col("h")).otherwise(F.col("h") - 1).alias("most_h"))
    limits = checkpoint(targets.join(edge, BY, "left").select(*BY, "source_size", "target", "whole", F.coalesce("most_h", F.lit(-1)).alias("most_h")))
    return F.broadcast(limits) if limits.count() <= BROADCAST_SOURCES else limits


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """How many words the mix takes of each row of ``docs(doc_id, text, source, ...)``.

    Returns doc_id, source, size, source_size, target, copies, taken. A source whose target is r times its size has all
    its rows floor(r) times and, for the rest, once more those below a threshold of a hash of doc_id (of the text where
    doc_id is null). Word sums by source and top 12 hash bits give the bucket that holds the threshold; only its rows
    are summed again, by the next 12 bits and then by whole hash. The row at the threshold is in if that comes nearer to
    the target. No row is sorted and reruns agree. Rows of one hash share their fate; null text has size 0; an empty table
    gives an empty one.
    """
    base = checkpoint(docs.select("doc_id", "source", *(c.alias(k) for k, c in _keyed(docs, seed).items())))
    copies = F.least(F.col("whole") + (F.col("h") <= F.col("most_h")).cast("long"), F.lit(int(most)))
    mixed = base.join(source_limits(base, weights, share, most), BY).withColumn("copies", copies)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The rows of the mix of ``docs``, with all columns as they are: each row as often as ``mix`` has copies of it.

    Only the limits meet the rows, by source; texts are not shuffled.
    """
    keys = _keyed(docs, seed)
    base = checkpoint(docs.select(*(c.alias(k) for k, c in keys.items())))
    limits = source_limits(base, weights, share, most)
    rows = docs.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in keys.items() if k != "size"))
    copies = F.least(F.col("whole") + (F.col("h") <= F.col("most_h")).cast("long"), F.lit(int(most))).cast("int")
    return rows.join(limits, BY).select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).select("row.*")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
p AS (SELECT *, 2.0::DOUBLE * source_size / weight AS stops_at FROM r),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM p WINDOW o AS (ORDER BY stops_at, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         CASE WHEN stops_at <= level THEN 2.0::DOUBLE * source_size
              ELSE weight * (SELECT arg_min(level, stops_at) FROM l WHERE stops_at > level) END AS target
  FROM l),
w AS (
  SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END), 2)::BIGINT AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS rest FROM w),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (
  SELECT c.source, CASE WHEN words - (rest - upto + words) <= rest - upto + words THEN h ELSE h - 1 END AS most_h
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE upto >= rest AND upto - words < rest)
SELECT d.doc_id, d.source, d.size, b.source_size, b.target,
       least(whole + (h <= coalesce(most_h, -1))::BIGINT, 2)::BIGINT AS copies,
       (d.size * least(whole + (h <= coalesce(most_h, -1))::BIGINT, 2))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM b.source
"""
