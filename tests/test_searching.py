"""Adaptive search on planted optima, against random draws."""

import json

import numpy as np
import pytest

from tidemark.models import fanout, searching

SPACE = {"level": searching.Span(0.01, 100.0, log=True), "lift": searching.Span(-5, 5), "kind": ["a", "b", "c", "d"], "n": searching.Span(1, 9, whole=True)}


class Planted:
    """Always forecasts one number: off the outcomes by what the parameters are off the best, which is level 3, lift 1, kind b, n 4."""

    def __init__(self, x, y, r, seed, level, lift, kind, n):
        self.gap = abs(np.log(level / 3)) + abs(lift - 1) + (0 if kind == "b" else 1) + 0.3 * abs(n - 4)
        self.mean = y.mean()

    def predict(self, x, y, r):
        return np.full(len(r), self.mean + self.gap)


BASE = {"kind": "custom", "factory": "tests.test_searching:Planted"}


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(4)
    made = [(e, k, float(g.normal()), float(2 + 0.1 * g.normal())) for e in ("a", "b") for k in range(200)]
    return spark.createDataFrame(made, "entity_id string, step long, r double, y double").cache()


def test_fewer_fits_than_random_for_a_lower_loss(spark, rows):
    found, seen = searching.adaptive_search(rows, BASE, SPACE, rounds=7, per_round=8, splits=2)
    best = {r.entity_id: r for r in found.collect()}
    assert {r.fits for r in best.values()} == {7 * (8 + 4)}
    g = np.random.default_rng(11)
    gap = lambda p: Planted(None, np.zeros(1), None, 0, **p).gap
    # random search with twice as many fold fits, two for each set that it tries
    draws = [min(gap(searching.drawn(SPACE, g)) for _ in range(7 * 12)) for _ in range(40)]
    assert np.mean([gap(json.loads(r.params_json)) for r in best.values()]) < np.median(draws)
    spent = seen.groupBy("entity_id", "folds").count().collect()
    assert {(r.folds, r["count"]) for r in spent} == {(1, 28), (2, 28)}


def test_reruns_agree_and_series_differ(spark, rows):
    runs = [sorted((r.entity_id, r.candidate, r.params_json, r.score) for r in searching.adaptive_search(rows.repartition(k), BASE, SPACE, rounds=2, per_round=4, splits=2)[1].collect()) for k in (1, 5)]
    assert [r[:3] for r in runs[0]] == [r[:3] for r in runs[1]] and [r[3] for r in runs[0]] == pytest.approx([r[3] for r in runs[1]])
    assert {r[2] for r in runs[0] if r[0] == "a"} != {r[2] for r in runs[0] if r[0] == "b"}


def test_proposals_stay_in_the_space_and_near_the_good():
    g = np.random.default_rng(0)
    seen = [searching.drawn(SPACE, g) for _ in range(60)]
    seen.sort(key=lambda p: abs(np.log(p["level"] / 3)))
    made = searching.proposed(SPACE, seen, 50, g)
    assert all(0.01 <= p["level"] <= 100 and -5 <= p["lift"] <= 5 and p["kind"] in "abcd" and p["n"] in range(1, 10) for p in made)
    assert np.median([abs(np.log(p["level"] / 3)) for p in made]) < 0.5 * np.median([abs(np.log(p["level"] / 3)) for p in seen])
    span = searching.Span(1e-3, 10, log=True)
    assert span.value(span.unit(0.2)) == pytest.approx(0.2) and searching.Span(1, 3, whole=True).value(0.4) == 2


def test_real_models_and_short_series(spark, rows):
    short = rows.filter("entity_id = 'a' or step < 1")
    found, _ = searching.adaptive_search(short, {"kind": "stes", "columns": ["r"], "params": {"restarts": 1}}, {"l2": searching.Span(1e-4, 10, log=True)}, rounds=2, per_round=2, splits=2)
    assert [r.entity_id for r in found.collect() if r.score is not None] == ["a"]
    with pytest.raises(Exception, match="unknown model kind"):
        searching.adaptive_search(rows, {"kind": "oracle"}, {"l2": [1]}, rounds=1, per_round=1, splits=2)[0].collect()
    assert "fold_value" in dir(fanout)
