"""Metrics that are plain functions, whole and in parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.plans import race


def median_ratio(y, yhat):
    return np.median(y / yhat)


PEARSON = metrics.Mergeable(
    lambda y, p: [len(y), y.sum(), p.sum(), (y * y).sum(), (p * p).sum(), (y * p).sum()],
    lambda parts: parts.sum(0),
    lambda t: (t[5] / t[0] - t[1] * t[2] / t[0] ** 2) / np.sqrt((t[3] / t[0] - (t[1] / t[0]) ** 2) * (t[4] / t[0] - (t[2] / t[0]) ** 2)),
)
WORST = metrics.Mergeable(lambda y, p: [np.abs(y - p).max()], lambda parts: parts.max(0), lambda t: t[0])


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(2)
    made = [(e, m, k, float(y), float(y * g.uniform(0.5, 1.5))) for e in ("a", "b", None) for m in ("ES", "GARCH") for k, y in enumerate(g.uniform(0.5, 2, 400))]
    made += [("a", "ES", 999, None, 1.0), ("a", "ES", 999, 1.0, None), ("a", "ES", 999, float("nan"), 1.0), ("lone", "ES", 0, None, 1.0)]
    return spark.createDataFrame(made, "entity_id string, model string, step long, y double, yhat double").repartition(7).cache()


def test_functions_and_parts_beside_each_other(rows):
    got = {(r.entity_id, r.model): r for r in metrics.by_functions(rows, ["entity_id", "model"], {"ratio": median_ratio, "pearson": PEARSON, "worst": WORST}).collect()}
    pdf = rows.toPandas().dropna(subset=["y", "yhat"])
    assert len(got) == 7 and (got[("lone", "ES")].ratio, got[("lone", "ES")].pearson) == (None, None)
    for (e, m), g in pdf.groupby(["entity_id", "model"], dropna=False):
        r = got[(e if isinstance(e, str) else None, m)]
        assert r.ratio == pytest.approx(np.median(g.y / g.yhat)) and r.worst == pytest.approx((g.y - g.yhat).abs().max())
        assert r.pearson == pytest.approx(np.corrcoef(g.y, g.yhat)[0, 1])


def test_over_all_rows_and_none(rows):
    whole = metrics.by_functions(rows.select("y", "yhat"), [], {"worst": WORST}).collect()
    pdf = rows.toPandas().dropna(subset=["y", "yhat"])
    assert [r.worst for r in whole] == [pytest.approx((pdf.y - pdf.yhat).abs().max())]
    assert metrics.by_functions(rows.limit(0), ["model"], {"worst": WORST, "ratio": median_ratio}).count() == 0


def test_parts_are_made_before_the_shuffle(rows):
    plan = metrics.by_functions(rows, ["model"], {"worst": WORST})._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert any("MapInPandas" in x for x in lines)
    below = plan[plan.index("FlatMapGroupsInPandas") :]
    assert below.index("Exchange") < below.index("MapInPandas")  # the exchange above the parts


def test_in_a_benchmark(spark, rows):
    named = rows.filter("entity_id is not null and y is not null and not isnan(y)").withColumn("ts_utc", F.timestamp_seconds("step"))
    out = race.benchmark(named, "ES", 200, extra={"ratio": median_ratio, "worst": WORST, "bias": F.avg(F.col("yhat") - F.col("y"))})["metrics"].collect()
    pdf = named.filter("step >= 200 and yhat is not null").toPandas().dropna()
    for r in out:
        g = pdf[(pdf.entity_id == r.entity_id) & (pdf.model == r.model)]
        assert (r.ratio, r.worst, r.bias) == (pytest.approx(np.median(g.y / g.yhat)), pytest.approx((g.y - g.yhat).abs().max()), pytest.approx((g.yhat - g.y).mean()))
    assert len(out) == 4
