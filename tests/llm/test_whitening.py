"""Whitening against numpy's eigenvectors of the whole covariance, and edges."""

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n int, x string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "c", 1, "x") for i, v in rows], SCHEMA).repartition(parts)


def plain(rows, k=4):
    """x, n, S, deviations and the leading eigenpairs of the covariance of the distinct x."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    once = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, total = len(once), once.sum(0)
    y = once - total / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return kept, n, total, values[::-1][:k], vectors[:, ::-1][:, :k], float((y**2).sum() / n)


def check(got, rows, k=4):
    kept, n, total, values, vectors, trace = plain(rows, k)
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    sign = {}
    for i, x in kept:
        x = np.array(x)
        for c in range(k):
            r = by[(i, c + 1)][0]
            want = (x - total / n) @ vectors[:, c] / np.sqrt(values[c])
            assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, total, strict=True))
            assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-8)
            if abs(want) > 1e-3:
                assert sign.setdefault(c, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
            assert r.explained == pytest.approx(values[c] / trace, rel=1e-9) and r.identity_error < 1e-9


@pytest.mark.parametrize("width, block", [(6, 64), (24, 4), (70, 8)])
def test_against_the_whole_covariance(spark, width, block):
    g = np.random.default_rng(width)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(g.normal(size=(300, width)) * np.linspace(1, 0.3, width) * 0.2)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [rows[3], (None, rows[4][1]), (2000, None), (2001, [None] * width), (2002, [float("nan")] * width), (2003, [float("inf")] + [0.0] * (width - 1))]
    got = whitening.whiten(frame(spark, rows), block=block).collect()
    check(got, [r for r in rows if r[0] is not None] + [(None, rows[4][1])])


@pytest.mark.parametrize("fan", [32, 2])
def test_partial_sums_meet_in_groups(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    g = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(g.normal(size=(90, 5)))]
    check(whitening.whiten(frame(spark, rows, 9), block=4).collect(), rows)


def test_iteration_certifies_close_eigenvalues():
    """The residuals of all k pairs end at the arithmetic's own error, also where eigenvalues are close; the count of passes is given."""
    g = np.random.default_rng(3)
    q, _ = np.linalg.qr(g.normal(size=(200, 200)))
    value = np.concatenate([[1.0, 0.999, 0.998, 0.997, 0.996], np.linspace(0.99, 0.1, 195)])
    a = (q * value) @ q.T
    calls = []
    values, vectors, residuals, passes = whitening.iterate(lambda b: calls.append(b.shape) or a @ b, 200, 4, 16, 300)
    assert values == pytest.approx(value[:4], abs=1e-12)
    assert np.abs(np.abs(np.sum(vectors * q[:, :4], axis=0)) - 1).max() < 1e-9
    assert residuals.max() <= 2e-13 and passes == len(calls) and all(s[1] <= 16 for s in calls)
    with pytest.raises(RuntimeError, match="after 2 passes"):
        whitening.iterate(lambda b: a @ b, 200, 4, 8, 2)


def test_little_or_no_variance(spark):
    line = [(i, [0.1 * i, 0.2 * i, 1.0]) for i in range(20)]
    got = whitening.whiten(frame(spark, line)).collect()
    assert {r.component for r in got} <= {1, 2} and len({r.vec_id for r in got}) == 20
    assert got[0].identity_error < 1e-6
    same = [(i, [0.5, 0.25]) for i in range(9)]
    assert whitening.whiten(frame(spark, same)).count() == 0
    assert whitening.whiten(frame(spark, [(1, []), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, same).limit(0)).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0])])).collect()


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[3, -5], [1 << 20, 7]], np.int64)
    n, total = 3_000, np.array([12, 1 << 30])
    want = [sum((n * int(a) - int(t)) ** 2 for a, t in zip(row, total, strict=True)) for row in x]
    assert whitening.deviations(x, n, total) == [d if d < 1 << 63 else None for d in want]
    assert whitening.deviations(np.array([[1 << 40]]), 1 << 20, np.array([0])) == [None]
