"""Predictive GARCH with linear channels for level, persistence and gate; exact gradients; boosted channels."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Protocol

import numpy as np

from ..functions.math import G_RANGE, MU_MIN, PHI_RANGE
from .boosting import Booster
from .optim import lbfgs
from .smoothing import sigmoid

H_MIN = 1e-12
CHANNELS = ("mu", "phi", "g")


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def links(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(mu, phi, g) and their slopes by the raw scores."""
    s, z = sigmoid(b), sigmoid(c)
    phi, g = PHI_RANGE[1] - PHI_RANGE[0], G_RANGE[1] - G_RANGE[0]
    return (MU_MIN + softplus(a), PHI_RANGE[0] + phi * s, G_RANGE[0] + g * z), (sigmoid(a), phi * s * (1 - s), g * z * (1 - z))


def raw(mu: np.ndarray | float, phi: np.ndarray | float, g: np.ndarray | float) -> tuple[np.ndarray, ...]:
    """The scores whose links give these values."""
    inverse = lambda p, r: np.log((p - r[0]) / (r[1] - p))
    m = np.asarray(mu, float) - MU_MIN
    return m + np.log(-np.expm1(-m)), inverse(np.asarray(phi, float), PHI_RANGE), inverse(np.asarray(g, float), G_RANGE)


@dataclass
class Path:
    """A variance path with what one backward pass needs: decay rho and each channel's impulse (0 where the floor holds)."""

    h: np.ndarray
    mu: np.ndarray
    phi: np.ndarray
    g: np.ndarray
    rho: np.ndarray
    impulses: np.ndarray


def forward(y: np.ndarray, scores: np.ndarray, h0: float | None = None) -> Path:
    """Recursion from rows of scores (n, 3); h_t is made of row t - 1."""
    (mu, phi, g), slopes = links(*scores.T)
    n = len(y)
    h, q, open_ = np.empty(n), np.empty(n), np.ones(n)
    h[0] = max(y[0] if h0 is None else h0, H_MIN)
    for t in range(n):
        q[t] = g[t] * y[t] + (1 - g[t]) * h[t]
        if t + 1 < n:
            nxt = (1 - phi[t]) * mu[t] + phi[t] * q[t]
            open_[t] = nxt > H_MIN
            h[t + 1] = max(nxt, H_MIN)
    impulses = np.stack([(1 - phi) * slopes[0], (q - mu) * slopes[1], phi * (y - h) * slopes[2]], axis=1) * open_[:, None]
    return Path(h, mu, phi, g, phi * (1 - g) * open_, impulses)


def row_loss(y: np.ndarray, h: np.ndarray, loss: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over t >= 1, and the first derivative and curvature weight of each row (0 at t = 0)."""
    n = max(len(y) - 1, 1)
    if loss == "mse":
        value, d, w = (y - h) ** 2, 2 * (h - y), np.full(len(y), 2.0)
    else:
        value, d, w = np.log(h) + y / h, 1 / h - y / (h * h), 1 / (h * h)
    d, w = d / n, w / n
    d[0] = w[0] = 0
    return float(value[1:].sum() / n), d, w


def backward(path: Path, d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Gauss-Newton curvature of the loss by each row's three scores; the last row has none."""
    n = len(d)
    grad, hess = np.zeros((n, 3)), np.zeros((n, 3))
    pull, weight = 0.0, 0.0
    for t in range(n - 2, -1, -1):
        pull = d[t + 1] + (path.rho[t + 1] * pull if t + 1 < n - 1 else 0.0)
        weight = w[t + 1] + (path.rho[t + 1] ** 2 * weight if t + 1 < n - 1 else 0.0)
        grad[t], hess[t] = pull * path.impulses[t], weight * path.impulses[t] ** 2
    return grad, hess


@dataclass
class LinearPGarch:
    """Each channel's score is w . [1, x]; a channel that is not dynamic has an intercept alone."""

    loss: str = "qlike"
    dynamic: tuple[str, ...] = CHANNELS
    l2: dict[str, float] = field(default_factory=dict)
    restarts: int = 1
    seed: int = 0
    standardise: bool = True
    w: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    def objective(self, z: np.ndarray, y: np.ndarray):
        mask = np.ones((z.shape[1], 3))
        mask[1:] = [c in self.dynamic for c in CHANNELS]
        ridge = np.array([self.l2.get(c, 0.0) for c in CHANNELS]) * np.r_[0.0, np.ones(z.shape[1] - 1)][:, None]

        def f(flat: np.ndarray):
            w = flat.reshape(-1, 3) * mask
            path = forward(y, z @ w)
            value, d, weight = row_loss(y, path.h, self.loss)
            grad = z.T @ backward(path, d, weight)[0] + ridge * w
            return value + 0.5 * float((ridge * w * w).sum()), (grad * mask).ravel()

        return f

    def fit(self, x: np.ndarray, y: np.ndarray) -> LinearPGarch:
        self.mean, self.scale = (x.mean(0), x.std(0)) if self.standardise else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.scale = np.where(self.scale > 0, self.scale, 1.0)
        z = self._design(x)
        start = np.zeros((z.shape[1], 3))
        start[0] = raw(max(float(np.mean(y)), 2 * MU_MIN), 0.98, 0.05)
        f, g = self.objective(z, y), np.random.default_rng(self.seed)
        tries = [lbfgs(f, (start + (0 if k == 0 else g.normal(0, 0.3, start.shape))).ravel()) for k in range(self.restarts)]
        flat, self.train_loss = min(tries, key=lambda t: t[1])
        mask = np.ones(start.shape)
        mask[1:] = [c in self.dynamic for c in CHANNELS]
        self.w = flat.reshape(-1, 3) * mask
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.w

    def predict_components(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        return links(*self.scores(x).T)[0]

    def predict_variance(self, x: np.ndarray, y: np.ndarray, h0: float | None = None) -> np.ndarray:
        return forward(y, self.scores(x), h0).h

    def next_variance(self, x: np.ndarray, y: np.ndarray) -> float:
        """The variance of the row that follows the last."""
        mu, phi, g = (float(c[-1]) for c in self.predict_components(x))
        h = self.predict_variance(x, y)[-1]
        return max((1 - phi) * mu + phi * (g * y[-1] + (1 - g) * h), H_MIN)

    def implied_garch(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        mu, phi, g = self.predict_components(x)
        return (1 - phi) * mu, phi * g, phi * (1 - g)

    def screen(self, k: int) -> dict[str, np.ndarray]:
        """For persistence and gate the k columns of largest coefficients."""
        return {c: np.argsort(-np.abs(self.w[1:, CHANNELS.index(c)]), kind="stable")[:k] for c in ("phi", "g")}


def curvatures(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Second derivatives of the links by the raw scores."""
    bend = lambda s, r: (r[1] - r[0]) * s * (1 - s) * (1 - 2 * s)
    u = sigmoid(a)
    return u * (1 - u), bend(sigmoid(b), PHI_RANGE), bend(sigmoid(c), G_RANGE)


def hessian(model: LinearPGarch, z: np.ndarray, y: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The exact second derivatives of ``model.objective(z, y)`` at ``flat``, by sensitivities carried forward with the recursion."""
    p = z.shape[1]
    mask = np.ones((p, 3))
    mask[1:] = [c in model.dynamic for c in CHANNELS]
    w = flat.reshape(-1, 3) * mask
    scores = z @ w
    path, (_, slopes) = forward(y, scores), links(*scores.T)
    bends = curvatures(*scores.T)
    n, m = len(y), 3 * p
    rows = max(n - 1, 1)
    jac, bent, total = np.zeros(m), np.zeros((m, m)), np.zeros((m, m))
    for t in range(n):
        if t:
            h = path.h[t]
            first, second = (2 * (h - y[t]), 2.0) if model.loss == "mse" else (1 / h - y[t] / h**2, -1 / h**2 + 2 * y[t] / h**3)
            total += (second * np.outer(jac, jac) + first * bent) / rows
        if t + 1 == n:
            break
        x = [np.zeros((p, 3)) for _ in range(3)]
        for k in range(3):
            x[k][:, k] = z[t] * mask[:, k]
        along = [v.ravel() for v in x]
        d_mu, d_phi, d_g = (slopes[k][t] * along[k] for k in range(3))
        dd_mu, dd_phi, dd_g = (bends[k][t] * np.outer(along[k], along[k]) for k in range(3))
        mu, phi, g, h = path.mu[t], path.phi[t], path.g[t], path.h[t]
        q = g * y[t] + (1 - g) * h
        d_q = d_g * (y[t] - h) + (1 - g) * jac
        dd_q = dd_g * (y[t] - h) - np.outer(d_g, jac) - np.outer(jac, d_g) + (1 - g) * bent
        cross = np.outer(d_phi, d_q - d_mu)
        if (1 - phi) * mu + phi * q > H_MIN:
            jac, bent = (1 - phi) * d_mu + phi * d_q + (q - mu) * d_phi, (1 - phi) * dd_mu + phi * dd_q + (q - mu) * dd_phi + cross + cross.T
        else:
            jac, bent = np.zeros(m), np.zeros((m, m))
    ridge = np.array([model.l2.get(c, 0.0) for c in CHANNELS]) * np.r_[0.0, np.ones(p - 1)][:, None] * mask
    return total + np.diag(ridge.ravel())


def constant(y: np.ndarray, loss: str = "qlike") -> LinearPGarch:
    """The intercept-only fit from which boosted models begin."""
    return LinearPGarch(loss=loss).fit(np.zeros((len(y), 0)), y)


class Initialiser(Protocol):
    """What boosted channels can begin from: any object that gives the components of each row, and the variance that they make."""

    def predict_components(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...

    def predict_variance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray: ...


def check_baseline(mu: np.ndarray, phi: np.ndarray, g: np.ndarray, inside: bool = False) -> None:
    """Components must be such as links give; to have scores of their own they must lie ``inside`` the links' ranges."""
    low, ranges = (MU_MIN, (PHI_RANGE, G_RANGE)) if inside else (0.0, ((0.0, 1.0), (0.0, 1.0)))
    if not (np.isfinite(mu).all() and (mu > low).all() and all(((c > a) & (c < z)).all() for c, (a, z) in zip((phi, g), ranges, strict=True))):
        raise ValueError(f"an initialiser must give mu > {low}, phi inside {ranges[0]} and g inside {ranges[1]}")


def baseline_scores(base: Initialiser, x: np.ndarray) -> np.ndarray:
    """The offsets (n, 3) from which boosters start, so that no tree is the baseline: the scores whose links are its components, which are checked."""
    if isinstance(base, LinearPGarch):  # its own scores; an intercept-only one sees no column
        x = x[:, :0] if base.w.shape[0] == 1 else x
        check_baseline(*base.predict_components(x))
        return base.scores(x).copy()
    parts = tuple(np.asarray(c, float) for c in base.predict_components(x))
    if len(parts) != 3 or any(c.shape != (len(x),) for c in parts):
        raise ValueError("an initialiser must give mu, phi and g of each row")
    check_baseline(*parts, inside=True)
    return np.stack(raw(*parts), axis=1)


@dataclass
class BoostedPGarch:
    """Trees on top of an initialiser's scores, channel after channel; ``order`` may name any channels, also again."""

    order: tuple[str, ...] = ("mu", "phi", "g")
    rounds: int = 20
    loss: str = "qlike"
    params: dict[str, dict] = field(default_factory=dict)
    columns: dict[str, list[int]] = field(default_factory=dict)
    patience: int = 5
    valid: float = 0.0

    def __post_init__(self) -> None:
        if not self.order or set(self.order) - set(CHANNELS):
            raise ValueError("order must name channels among mu, phi, g")

    def _x(self, x: np.ndarray, c: str) -> np.ndarray:
        return x[:, self.columns[c]] if c in self.columns else x

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = baseline_scores(self.base, x)
        for k, c in enumerate(CHANNELS):
            out[:, k] += self.boosters[c].predict(self._x(x, c))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, base: Initialiser | None = None) -> BoostedPGarch:
        """Each round updates every channel of the order by one tree, from the scores of ``base`` on; a validation tail restores the best round.

        The variance that a base says it predicts must be that of its components: then no round at all is the base itself.
        """
        cut = len(y) - int(self.valid * len(y))
        self.base = constant(y[:cut], self.loss) if base is None else base
        if base is not None:
            own, made = np.asarray(base.predict_variance(x[:, :0] if isinstance(base, LinearPGarch) and base.w.shape[0] == 1 else x, y), float), forward(y, baseline_scores(base, x)).h
            if own.shape != made.shape or not np.allclose(own, made, rtol=1e-6):
                raise ValueError("an initialiser's variance must be that of its components")
        self.boosters = {c: Booster(**self.params.get(c, {})) for c in CHANNELS}
        best, self.best_round, self.history = np.inf, 0, []
        snapshot = {c: 0 for c in CHANNELS}
        for k in range(1, self.rounds + 1):
            for c in self.order:
                path = forward(y[:cut], self.scores(x[:cut]))
                _, d, w = row_loss(y[:cut], path.h, self.loss)
                grad, hess = (m[:, CHANNELS.index(c)] for m in backward(path, d, w))
                self.boosters[c].add(self._x(x[:cut], c), grad * cut, np.maximum(hess * cut, 1e-12))
            h = forward(y, self.scores(x)).h
            watched = row_loss(y[cut:], h[cut:], self.loss)[0] if cut < len(y) else row_loss(y, h, self.loss)[0]
            self.history.append(watched)
            if watched < best:
                best, self.best_round = watched, k
                snapshot = {c: len(b.trees) for c, b in self.boosters.items()}
            elif cut < len(y) and k - self.best_round >= self.patience:
                break
        if cut < len(y):
            for c, b in self.boosters.items():
                b.trees = b.trees[: snapshot[c]]
        return self

    def predict_variance(self, x: np.ndarray, y: np.ndarray, h0: float | None = None) -> np.ndarray:
        return forward(y, self.scores(x), h0).h

    def refit(self, x: np.ndarray, y: np.ndarray) -> BoostedPGarch:
        """A fit on all rows for as many rounds as were best on the validation tail."""
        rounds = max(self.fit(x, y).best_round, 1)
        return BoostedPGarch(self.order, rounds, self.loss, self.params, self.columns).fit(x, y)


@dataclass(frozen=True)
class ChannelPlan:
    """Which channels a boosted model learns, in which order, by which columns, and each one's own booster parameters."""

    order: tuple[str, ...] = CHANNELS
    rounds: int = 20
    common: dict = field(default_factory=dict)
    overrides: dict[str, dict] = field(default_factory=dict)
    columns: dict[str, list[int]] = field(default_factory=dict)
    loss: str = "qlike"

    def __post_init__(self) -> None:
        named = set(self.order) | set(self.overrides) | set(self.columns)
        if not self.order or named - set(CHANNELS):
            raise ValueError(f"channels are {CHANNELS}, not {sorted(named - set(CHANNELS))}")
        allowed = {f.name for f in fields(Booster)} - {"trees"}
        for params in (self.common, *self.overrides.values()):
            if set(params) - allowed:
                raise ValueError(f"unknown booster parameters {sorted(set(params) - allowed)}")
        if self.rounds < 1 or self.loss not in ("mse", "qlike"):
            raise ValueError("rounds must be positive and loss mse or qlike")

    def model(self, **more) -> BoostedPGarch:
        return BoostedPGarch(self.order, self.rounds, self.loss, {c: self.common | self.overrides.get(c, {}) for c in CHANNELS}, self.columns, **more)


def screened(x: np.ndarray, y: np.ndarray, k: int, plan: ChannelPlan | None = None, valid: float = 0.2) -> BoostedPGarch:
    """A boosted fit by the columns that a linear fit on the rows before the validation tail ranks first for each channel."""
    plan = plan or ChannelPlan(("phi", "g"))
    first = LinearPGarch(loss=plan.loss).fit(x[: len(y) - int(valid * len(y))], y[: len(y) - int(valid * len(y))])
    return replace(plan, columns={c: at.tolist() for c, at in first.screen(k).items()}).model(valid=valid).refit(x, y)


def g_only(**params) -> BoostedPGarch:
    return BoostedPGarch(order=("g",), **params)


def blend(scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Experts' raw scores (experts, n, 3) by normalised weights, one an expert or one an expert and row."""
    w = weights / weights.sum(0, keepdims=True)
    return np.einsum("en,enk->nk", np.broadcast_to(w[:, None] if w.ndim == 1 else w, scores.shape[:2]), scores)
