"""Recursions in blocks against the same in one group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import recursion, scan


def series(spark, n=1000, missing=0.0):
    g = np.random.default_rng(n)
    rows = []
    for name, many in (("long", n), ("one", 1), ("short", 70)):
        for t in range(many):
            x = float(g.normal())
            rows.append((name, t, None if g.uniform() < missing else x, float(g.uniform(0.01, 0.99)), float(abs(g.normal())), float(g.uniform(0.5, 0.99)), "k"))
    rows += [(None, t, 0.5, 0.1, 1.0, 0.9, "k") for t in range(20)]
    return spark.createDataFrame(rows, "entity_id string, ts_utc int, r double, gate double, y double, rho double, _s string").repartition(5)


def same(a, b, *columns):
    key = lambda r: (r["entity_id"] or "", r["ts_utc"])
    x, z = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert [key(r) for r in x] == [key(r) for r in z] and a.columns == b.columns
    for c in columns:
        left, right = ([np.nan if r[c] is None else r[c] for r in rows] for rows in (x, z))
        assert left == pytest.approx(right, rel=1e-9, abs=1e-12, nan_ok=True), c


RUNS = {
    "constant gate": (lambda df, **k: recursion.smooth_by(df, "r", 0.1, **k), ["yhat"]),
    "gate column": (lambda df, **k: recursion.smooth_by(df, "r", "gate", **k), ["yhat"]),
    "given start": (lambda df, **k: recursion.smooth_by(df, "r", 0.3, v0=2.0, **k), ["yhat"]),
    "filter": (lambda df, **k: recursion.filter_by(df, "r", "gate", window=100, **k), ["state", "yhat"]),
    "garch": (lambda df, **k: recursion.garch_by(df, "r", 0.05, 0.1, 0.85, 1.0, **k), ["h"]),
    "pgarch": (lambda df, **k: recursion.pgarch_by(df, "y", 0.5, "rho", "gate", **k), ["h"]),
    "pgarch at its floor": (lambda df, **k: recursion.pgarch_by(df, "y", "r", "rho", "gate", least=0.4, **k), ["h"]),
    "adjoint": (lambda df, **k: recursion.adjoint_by(df, "r", "rho", **k), ["pull", "weight"]),
    "averages": (lambda df, **k: recursion.ewma_by(df, ["r", "y"], [2.0, 7.0], **k), ["ewma.r.hl=2", "ewma.r.hl=7", "ewma.y.hl=2"]),
}


@pytest.mark.parametrize("name", RUNS)
def test_blocks_are_one_series(spark, name):
    run, columns = RUNS[name]
    df = series(spark).cache()
    same(run(df, block_rows=16), run(df), *columns)


def test_averages_carry_gaps_over_blocks(spark):
    """Blocks without a value, before the first one and in between, let weights decay as in one group."""
    df = series(spark, 400, missing=0.85).cache()
    run, columns = RUNS["averages"]
    same(run(df, block_rows=4), run(df), *columns)


def test_no_block_is_larger_than_asked_for(spark):
    df = series(spark, 5000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few enough for one partition
    try:
        cut = scan.blocks(df, ["entity_id"], ["ts_utc"], 64).cache()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = cut.groupBy("entity_id", "_block").agg(F.count("*").alias("n"), F.min("ts_utc").alias("a"), F.max("ts_utc").alias("z"))
    assert sizes.agg(F.max("n")).first()[0] <= 64
    assert sizes.filter("z - a + 1 <> n").count() == 0  # consecutive
    assert sizes.filter("entity_id = 'long'").count() >= 64 and cut.filter("entity_id = 'long'").select(F.shiftright("_at", 33)).distinct().count() > 1
    order = cut.filter("entity_id = 'long'").orderBy("_at").select("ts_utc").collect()
    assert [r.ts_utc for r in order] == list(range(5000))


def test_empty_input_and_negative_slopes(spark):
    df = series(spark, 10)
    assert recursion.smooth_by(df.limit(0), "r", 0.1, block_rows=8).count() == 0
    with pytest.raises(Exception, match="negative"):
        recursion.pgarch_by(df, "y", 0.5, "rho", 1.5, block_rows=8).collect()


def test_composition_of_maps():
    g = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 17, 64):
        a, b, c = g.uniform(0, 1.1, n), g.normal(size=n), g.normal(size=n)
        a[: n // 3] = 0
        slope, shift, floor = scan.composed(a, b, c)
        for x in (-3.0, 0.0, 5.0):
            v = x
            for k in range(n):
                v = max(a[k] * v + b[k], c[k])
            assert max(slope * x + shift, floor) == pytest.approx(v, abs=1e-12)
