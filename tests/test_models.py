"""Gradients against differences, recovery, invariants, and equal models that must agree."""

import numpy as np
import pytest

from tidemark.models import boosting, fanout, gated, pgarch, recurrent, smoothing

G = np.random.default_rng(0)
N = 220
X = np.column_stack([np.ones(N), np.sin(np.arange(N) / 5), G.normal(size=N)])
R = G.normal(size=N) * (1 + 0.5 * np.sin(np.arange(N) / 8))
Y = np.append(R[1:] ** 2, R[-1] ** 2)


def slope(f, t, e=1e-6):
    return np.array([(f(t + e * d) - f(t - e * d)) / (2 * e) for d in np.eye(len(t))])


def test_smoother_slopes():
    b = np.array([-1.0, 0.3, 0.2])
    _, _, d = smoothing.path_with_slopes(X, R**2, b)
    assert np.abs(slope(lambda t: smoothing.path_with_slopes(X, R**2, t)[1], b).T - d).max() < 1e-7
    f = smoothing.Smoother(["const", "a", "b"], loss="qlike", l2=0.01, entropy=0.5).objective(X, Y, R**2)
    assert np.abs(slope(lambda t: f(t)[0], b) - f(b)[1]).max() < 1e-5


@pytest.mark.parametrize("loss", ["mse", "qlike"])
def test_smoother_beats_constant_gate(loss):
    one = smoothing.Smoother(["const"], loss=loss).fit(X[:, :1], Y, R)
    all_ = smoothing.Smoother(["const", "a", "b"], loss=loss, restarts=4).fit(X, Y, R)
    assert all_.train_loss <= one.train_loss * 1.001
    gates = all_.gates(X)
    assert ((gates > 0) & (gates < 1)).all() and all_.last == pytest.approx(all_.predict(X, R)[-1])
    with pytest.raises(ValueError):
        all_.guard(["a", "const", "b"])
    strong = smoothing.Smoother(["const", "a", "b"], loss=loss, l2=100.0).fit(X, Y, R)
    assert np.abs(strong.beta[1:]).max() < 0.05
    assert (smoothing.adaptive_weights(X, Y, R, ["const", "a", "b"]) > 0).all()


@pytest.mark.parametrize("loss", ["mse", "qlike"])
def test_pgarch(loss):
    model = pgarch.LinearPGarch(loss=loss, l2={"mu": 0.1}, standardise=False)
    model.mean, model.scale = np.zeros(2), np.ones(2)
    f, w = model.objective(X, Y), G.normal(size=9) * 0.3
    assert np.abs(slope(lambda t: f(t)[0], w) - f(w)[1]).max() < 1e-6
    fitted = pgarch.LinearPGarch(loss=loss).fit(X[:, 1:], Y)
    assert fitted.train_loss <= pgarch.constant(Y, loss).train_loss + 1e-9
    mu, phi, g = fitted.predict_components(X[:, 1:])
    omega, alpha, beta = fitted.implied_garch(X[:, 1:])
    assert (mu > 0).all() and ((phi > 0) & (phi < 1) & (g > 0) & (g < 1)).all()
    assert np.allclose(alpha + beta, phi) and np.allclose(omega, (1 - phi) * mu) and fitted.next_variance(X[:, 1:], Y) > 0
    fixed = pgarch.LinearPGarch(loss=loss, dynamic=("mu",)).fit(X[:, 1:], Y)
    assert (fixed.w[1:, 1:] == 0).all() and len(fitted.screen(1)["phi"]) == 1


def test_backward_has_no_terminal_row_and_no_pull_through_the_floor():
    path = pgarch.forward(Y[:7], G.normal(size=(7, 3)))
    grad, hess = pgarch.backward(path, np.ones(7), np.ones(7))
    assert (grad[-1] == 0).all() and (hess[-1] == 0).all() and (hess >= 0).all()
    a, b, c = pgarch.raw(0.5, 0.9, 0.1)
    (mu, phi, g), _ = pgarch.links(np.array([a]), np.array([b]), np.array([c]))
    assert (mu[0], phi[0], g[0]) == pytest.approx((0.5, 0.9, 0.1))


def test_boosting_lowers_the_loss():
    full = pgarch.BoostedPGarch(rounds=6).fit(X[:, 1:], Y)
    assert full.history[-1] < full.history[0]
    only = pgarch.g_only(rounds=3).fit(X[:, 1:], Y)
    assert not only.boosters["mu"].trees and len(only.boosters["g"].trees) == 3
    early = pgarch.BoostedPGarch(rounds=30, valid=0.2, patience=2).fit(X[:, 1:], Y)
    assert len(early.boosters["mu"].trees) == early.best_round
    with pytest.raises(ValueError):
        pgarch.BoostedPGarch(order=("omega",))
    tree = boosting.BoostedSmoother(rounds=15, valid=0.0).fit(X[:, 1:], Y, R)
    assert tree.history[-1] < tree.history[0] and ((tree.gates(X[:, 1:]) > 0) & (tree.gates(X[:, 1:]) < 1)).all()
    linear = boosting.BoostedSmoother(rounds=15, valid=0.0, booster={"linear": True}).fit(X[:, 1:], Y, R)
    assert linear.history[-1] < linear.history[0]
    assert np.isfinite(boosting.alternate(X[:, 1:], Y, R).predict(X[:, 1:], R)).all()


def test_gate_slopes_through_time():
    margin = G.normal(size=N) * 0.5
    f = lambda t: 0.5 * ((boosting.gate_slopes(Y, R**2, t, 1.0)[0] - Y) ** 2).sum()
    assert np.abs(slope(f, margin) - boosting.gate_slopes(Y, R**2, margin, 1.0)[1]).max() < 1e-5


@pytest.mark.parametrize("gate", ["stes", "gru_linear"])
@pytest.mark.parametrize("candidate", ["r2", "linear_pos"])
@pytest.mark.parametrize("loss", ["mse", "nll", "qlike"])
def test_gated_slopes(gate, candidate, loss):
    model = gated.GatedVariance(gated.GatedConfig(gate=gate, candidate=candidate, loss=loss, states=2, entropy=0.1, group_lasso=0.01))
    f = model.objective(X[:60], Y[:60], R[:60], np.ones(2))
    t = np.random.default_rng(1).normal(size=model._size(3)) * 0.2
    assert np.abs(slope(lambda z: f(z)[0], t) - f(t)[1]).max() < 1e-4


@pytest.mark.parametrize("candidate", ["linear_pos", "mlp_pos"])
@pytest.mark.parametrize("reset", [False, True])
@pytest.mark.parametrize("positive", ["softplus", "exp"])
def test_gated_slopes_of_candidates(candidate, reset, positive):
    model = gated.GatedVariance(gated.GatedConfig(gate="gru_linear", candidate=candidate, reset=reset, hidden=3, positive=positive, states=2, stay_close=0.1))
    f = model.objective(X[:40], Y[:40], R[:40], np.ones(2), np.zeros((3, 2)))
    t = np.random.default_rng(2).normal(size=model._size(3)) * 0.2
    assert np.abs(slope(lambda z: f(z)[0], t) - f(t)[1]).max() < 1e-4


def test_epochs_come_from_the_folds():
    cfg = gated.GatedConfig(candidate="mlp_pos", valid=0.3, epochs=40, patience=3)
    net = gated.GatedVariance(cfg).fit(X, Y, R)
    last = gated.after_validation(cfg, [net.epochs, net.epochs + 2])
    assert last.valid == 0 and last.epochs == net.epochs + 1 and cfg.epochs == 40
    for wrong in ({"reset": True, "rate": 0}, {"hidden": 0}, {"positive": "square"}, {"decay": -1.0}):
        with pytest.raises(ValueError):
            gated.GatedConfig(**wrong)


@pytest.mark.parametrize("loss", ["mse", "qlike"])
def test_pgarch_hessian(loss):
    model = pgarch.LinearPGarch(loss=loss, l2={"mu": 0.1, "g": 0.2}, dynamic=("mu", "g"))
    f, w = model.objective(X[:80], Y[:80] + 0.1), np.random.default_rng(3).normal(size=9) * 0.3
    numeric = np.array([(f(w + 1e-5 * e)[1] - f(w - 1e-5 * e)[1]) / 2e-5 for e in np.eye(9)])
    assert np.abs(pgarch.hessian(model, X[:80], Y[:80] + 0.1, w) - numeric).max() < 1e-5


def test_channel_plan():
    plan = pgarch.ChannelPlan(("phi", "g"), 4, {"depth": 2}, {"g": {"rate": 0.3}})
    made = plan.model()
    assert made.params["g"] == {"depth": 2, "rate": 0.3} and made.params["phi"] == {"depth": 2}
    for wrong in ({"order": ("omega",)}, {"overrides": {"g": {"leaves": 3}}}, {"rounds": 0}):
        with pytest.raises(ValueError):
            pgarch.ChannelPlan(**wrong)
    fitted = pgarch.screened(X[:, 1:], Y, 1, plan)
    assert all(len(at) == 1 for at in fitted.columns.values()) and np.isfinite(fitted.predict_variance(X[:, 1:], Y)).all()
    assert fitted.boosters["g"].importance(1).sum() > 0 and fitted.boosters["mu"].importance(1).sum() == 0


def test_newton_stays_at_the_clipped_gate():
    g = np.random.default_rng(4)
    for _ in range(200):
        y, v, r2, delta = g.exponential(), g.exponential(), g.exponential(), g.exponential()
        a = start = float(np.clip((y - v) / (r2 - v), 0, 1))
        for _ in range(15):
            first, second = boosting.loss_slopes(np.array([y]), np.array([v + a * (r2 - v)]), "huber", delta)
            a = float(np.clip(a - first[0] * (r2 - v) / (second[0] * (r2 - v) ** 2), 0, 1))
        assert a == pytest.approx(start, abs=1e-9)


def test_gated_equals_smoother_and_learns():
    b = np.array([0.1, -0.2, 0.3])
    want = smoothing.smooth(R**2, smoothing.sigmoid(X @ b))
    assert np.abs(gated.from_smoother(b, R[0] ** 2).predict(X, R) - want).max() < 1e-10
    short, long = (gated.GatedVariance(gated.GatedConfig(epochs=e)).fit(X, Y, R).train_loss for e in (2, 60))
    assert long < short
    with pytest.raises(ValueError):
        gated.GatedConfig(gate="lstm")


@pytest.mark.parametrize("cell", ["rnn", "gru"])
@pytest.mark.parametrize("head", ["variance", "gate"])
@pytest.mark.parametrize("loss", ["mse", "qlike"])
def test_recurrent_slopes(cell, head, loss):
    net = recurrent.Recurrent(cell, head, 3, loss)
    f = net.objective(X[:40, 1:], Y[:40], R[:40], 1.0)
    t = np.random.default_rng(5).normal(size=net._size(2)) * 0.4
    assert np.abs(slope(lambda z: f(z)[0], t) - f(t)[1]).max() < 1e-5


def test_recurrent_learns():
    for cell, head in (("rnn", "variance"), ("gru", "gate")):
        short, long = (recurrent.Recurrent(cell, head, 4, epochs=e).fit(X[:, 1:], Y, R) for e in (2, 60))
        assert long.train_loss < short.train_loss and (long.predict(X[:, 1:], R) > 0).all()
    gates = long.gates(X[:, 1:], R)
    assert ((gates > 0) & (gates < 1)).all()
    for wrong in ({"cell": "lstm"}, {"head": "mean"}, {"hidden": 0}):
        with pytest.raises(ValueError):
            recurrent.Recurrent(**wrong)


def test_blend():
    scores = np.stack([np.zeros((3, 3)), np.ones((3, 3)) * 4])
    assert pgarch.blend(scores, np.array([1.0, 3.0])).tolist() == [[3.0] * 3] * 3
    assert pgarch.blend(scores, np.array([[3.0, 1, 1], [1, 3, 3]]))[:, 0].tolist() == [1.0, 3.0, 3.0]


def test_garch_recovers_persistence():
    from tidemark.sources.simulated import path

    r, _ = path(3000, 7, eta=0.0)
    _, alpha, beta = fanout.garch_fit(r)
    assert 0.9 < alpha + beta < 1 and 0.05 < alpha < 0.2
    assert len(fanout.random_specs({"kind": "stes"}, {"l2": [0, 1]}, 3)) == 3


class Components:
    def __init__(self, mu=0.8, phi=0.9, g=0.2, off=0.0):
        self.parts, self.off = (mu, phi, g), off

    def predict_components(self, x):
        return tuple(np.full(len(x), float(p)) for p in self.parts)

    def predict_variance(self, x, y):
        from tidemark.operators.recursion import pgarch as path

        return path(y, *self.predict_components(x)) + self.off


def test_boosted_channels_start_from_any_baseline():
    from tidemark.models import pgarch

    g = np.random.default_rng(0)
    x, y = g.normal(size=(300, 2)), g.exponential(size=300)
    base = Components()
    none = pgarch.BoostedPGarch(rounds=0).fit(x, y, base)
    assert none.predict_variance(x, y) == pytest.approx(base.predict_variance(x, y), rel=1e-12)
    linear = pgarch.LinearPGarch(loss="qlike").fit(x, y)
    assert pgarch.BoostedPGarch(rounds=0).fit(x, y, linear).predict_variance(x, y) == pytest.approx(linear.predict_variance(x, y), rel=1e-12)
    some = pgarch.BoostedPGarch(rounds=5).fit(x, y, base)
    loss = lambda h: pgarch.row_loss(y, h, "qlike")[0]
    assert loss(some.predict_variance(x, y)) < loss(base.predict_variance(x, y))
    for bad in (Components(phi=1.5), Components(mu=-1.0), Components(g=float("nan"))):
        with pytest.raises(ValueError, match="initialiser must give"):
            pgarch.BoostedPGarch(rounds=0).fit(x, y, bad)
    with pytest.raises(ValueError, match="that of its components"):
        pgarch.BoostedPGarch(rounds=0).fit(x, y, Components(off=0.1))


def test_boosted_gates_start_from_a_smoother():
    from tidemark.models import boosting, fanout
    from tidemark.operators.recursion import initial_variance, smooth

    g = np.random.default_rng(1)
    r = g.normal(size=300) * np.repeat([0.5, 2.0, 1.0], 100)
    y, x = np.append(r[1:] ** 2, 1.0), np.column_stack([np.ones(300), g.normal(size=300)])
    first = fanout.fit_one({"kind": "stes", "columns": ["a"], "params": {"restarts": 1}}, x, y, r).model
    spec = {"kind": "xgb_stes", "columns": ["a"], "params": {"rounds": 0, "valid": 0.0}, "init": {"kind": "stes", "params": {"restarts": 1}}}
    made = fanout.fit_one(spec, x, y, r)
    assert made.gates(x, r) == pytest.approx(first.gates(x), rel=1e-12)
    assert made(x, y, r) == pytest.approx(smooth(r**2, first.gates(x), initial_variance(r**2)), rel=1e-12)
    stored = fanout.unpacked(fanout.packed(fanout.fit_one(spec | {"params": {"rounds": 3}}, x, y, r)), ["a"])
    assert stored.gates(x, r).shape == (300,) and not np.allclose(stored.gates(x, r), first.gates(x))

    class Bad:
        def gates(self, x):
            return np.ones(len(x))

    with pytest.raises(ValueError, match="between 0 and 1"):
        boosting.BoostedSmoother(init=Bad()).fit(x[:, 1:], y, r)
