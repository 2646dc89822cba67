"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


#: A join on a node is dealt to so many tasks, as one node may have a third of all links.
SALTS = 8
#: Links that a task takes in the rounds: a small table does not go through as many tasks and checkpoint files as a large one.
TASK_ROWS = 500_000


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root) for every node of ``links(a, b)`` (longs) that has a smaller one: the least node of its component.

    Each round, every node sends its larger neighbours, and then its smaller ones, the least node that it knows. Each
    is an aggregation, which combines before its shuffle, and a join. A hub's larger neighbours meet what it knows in ``SALTS``
    tasks. Links are cut off by a checkpoint in each round, in as many parts as their number asks for. Null ends and links of a node with itself count for nothing.
    """
    ends = links.filter(F.col("a") != F.col("b"))
    edges = checkpoint(ends.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct())
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    parts = max(1, -(-edges.count() // TASK_ROWS))
    for _ in range(most_rounds):
        once = edges.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        moved = checkpoint(edges.select(F.col("root").alias("u")).distinct().join(once.select(F.col("v").alias("u"), "low"), "u").coalesce(parts))
        if moved.isEmpty() and once.filter("low <> high").isEmpty():
            return edges
        salted = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        to = moved.select(F.col("u").alias("root"), "low", salts.alias("_s"))
        large = salted.join(to, ["root", "_s"], "left").select("v", F.coalesce("low", "root").alias("root")).distinct()
        least = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(least, "v").select(F.col("root").alias("v"), F.col("m").alias("root")).unionByName(least.select("v", F.col("m").alias("root")))
        edges = checkpoint(small.filter(F.col("v") != F.col("root")).distinct().coalesce(parts))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
