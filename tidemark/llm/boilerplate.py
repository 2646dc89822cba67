"""Line dedup: lines that stand on many distinct sites are boilerplate and go. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: A set of line keys with so many rows at most is part of the plan, and lines are looked up where they are read.
IN_PLACE = 10_000
#: One with so many is broadcast, a larger one is joined by a shuffle.
BROADCAST_KEYS = 200_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _trim(line: Column) -> Column:
    """F.trim itself, handed to F.transform, would take the line's number as the characters to trim."""
    return F.trim(line)


def boilerplate_lines(docs: DataFrame, sites: int, lg_k: int) -> DataFrame:
    """_h, the hash of each line of ``docs(source, text)`` on ``sites`` distinct sources or more."""
    keyed = docs.filter(F.col("source").isNotNull()).select("source", F.explode(F.transform(_lines(F.col("text")), _trim)).alias("_line")).filter(F.length("_line") > 0).select("source", F.xxhash64("_line").alias("_h"))
    spread = keyed.groupBy("_h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(lg_k))).alias("_sites"))
    margin = max(1, int(-(-3 * 1.04 * sites // (1 << lg_k // 2))))
    judged = checkpoint(spread.filter(F.col("_sites") >= sites - margin))
    near = judged.filter(F.col("_sites") <= sites + margin).select("_h")
    sure = judged.filter(F.col("_sites") > sites + margin).select("_h")
    many = near.count()
    if not many:
        return sure
    near = F.broadcast(near) if many <= BROADCAST_KEYS else near
    exact = keyed.join(near, "_h", "left_semi").distinct().groupBy("_h").count()
    return checkpoint(sure.unionByName(exact.filter(F.col("count") >= sites).select("_h")))


def remove_boilerplate(docs: DataFrame, sites: int = 10, whole_copies: bool = False, lg_k: int = 12, in_place: int = IN_PLACE) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with the text without boilerplate, and behind its columns _n_lines and _n_removed.

    A line (spaces at its ends do not count, empty lines never count) is boilerplate if it stands on ``sites`` distinct
    sources or more; a null source is none. It goes from every row. HyperLogLog sketches of the sources, one a line hash, are merged by the
    aggregation, so that a line in a third of all rows costs each task one sketch. A line whose estimate is near the
    threshold has its distinct sources counted exactly; the others are further from it than three standard errors.
    Up to ``in_place`` such lines are looked up where the text is read, without a shuffle; more are joined with the lines.
    With ``whole_copies`` a row all of whose lines are boilerplate stays whole, for a removal of near copies to judge. Null text
    stays null; an empty table gives an empty one; repeated rows fare alike; columns named _n_lines and _n_removed are replaced.
    """
    names = [c for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    known = boilerplate_lines(docs.select("source", "text"), sites, lg_k)
    rows = docs.select(F.struct(*(F.col(c) for c in names if c != "text")).alias("_row"), "text")
    if known.count() <= in_place:
        of_plan = ", ".join(f"{r['_h']}L" for r in known.collect()) or "NULL"
        at = rows.withColumn("_lines", _lines(F.col("text"))).withColumn("_gone", F.expr(f"filter(transform(_lines, (x, i) -> if(xxhash64(trim(x)) IN ({of_plan}), i, -1)), i -> i >= 0)"))
    else:
        known = F.broadcast(known) if known.count() <= BROADCAST_KEYS else known
        keyed = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.posexplode(F.transform(_lines(F.col("text")), _trim)).alias("_at", "_line")).withColumn("_h", F.xxhash64("_line"))
        hits = keyed.join(known, "_h").select("doc_id", "_th", "_at").distinct().groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_t")).agg(F.collect_list("_at").alias("_gone"))
        at = rows.join(hits, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_t")), "left").withColumn("_lines", _lines(F.col("text")))
        at = at.withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    if whole_copies:
        own = F.size(F.filter("_lines", lambda x: F.length(F.trim(x)) > 0)) > F.size("_gone")
        at = at.withColumn("_gone", F.when(own, F.col("_gone")).otherwise(F.array().cast("array<int>")))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.get("_lines", i))
    text = F.when(F.size("_gone") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    return at.select(*((text if c == "text" else F.col("_row").getField(c)).alias(c) for c in names), count.alias("_n_lines"), F.size("_gone").cast("long").alias("_n_removed"))


OP2_SQL = r"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT rid, source, unnest(generate_series(1, len(ls))) AS pos, trim(unnest(ls)) AS line FROM r WHERE text IS NOT NULL),
b AS (SELECT line FROM e WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
h AS (SELECT rid, count(*) AS n FROM e JOIN b USING (line) GROUP BY rid),
k AS (SELECT e.rid, string_agg(r.ls[e.pos], chr(10) ORDER BY e.pos) AS kept FROM e JOIN r USING (rid) WHERE line NOT IN (SELECT line FROM b) GROUP BY e.rid)
SELECT r.doc_id, coalesce(len(r.ls), 0)::BIGINT AS n_lines, coalesce(h.n, 0)::BIGINT AS n_removed,
       CASE WHEN h.n IS NULL THEN r.text ELSE coalesce(k.kept, '') END AS text
FROM r LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)
"""
