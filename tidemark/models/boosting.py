"""A second-order booster of small histogram trees or of a linear model, and the smoothing gate that it learns end to end."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..operators.recursion import initial_variance, smooth, states
from .smoothing import score, sigmoid


@dataclass
class Booster:
    """Trees of given depth on quantile bins, or (``linear``) one shrunken Newton step a round on all columns."""

    depth: int = 3
    rate: float = 0.1
    l2: float = 1.0
    bins: int = 32
    least_hess: float = 1e-6
    linear: bool = False
    monotone: tuple[int, ...] = ()
    trees: list = field(default_factory=list)

    def _split(self, codes: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, int]:
        best = (1e-12, -1, -1)
        total_g, total_h = grad.sum(), hess.sum()
        whole = total_g**2 / (total_h + self.l2)
        for j in range(codes.shape[1]):
            g = np.cumsum(np.bincount(codes[:, j], grad, self.bins))[:-1]
            h = np.cumsum(np.bincount(codes[:, j], hess, self.bins))[:-1]
            ok = (h > self.least_hess) & (total_h - h > self.least_hess)
            left, right = -g / (h + self.l2), -(total_g - g) / (total_h - h + self.l2)
            if j < len(self.monotone) and self.monotone[j]:
                ok &= self.monotone[j] * (right - left) >= 0
            gain = np.where(ok, g**2 / (h + self.l2) + (total_g - g) ** 2 / (total_h - h + self.l2) - whole, -np.inf)
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        return best

    def _grow(self, codes: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int):
        leaf = float(-self.rate * grad.sum() / (hess.sum() + self.l2))
        if depth == 0 or len(grad) < 2:
            return leaf
        _, j, k = self._split(codes, grad, hess)
        if j < 0:
            return leaf
        left = codes[:, j] <= k
        value = float(edges[j][k]) if k < len(edges[j]) else np.inf
        return j, value, self._grow(codes[left], edges, grad[left], hess[left], depth - 1), self._grow(codes[~left], edges, grad[~left], hess[~left], depth - 1)

    def importance(self, width: int) -> np.ndarray:
        """How often each column splits; of a linear booster the size of its summed coefficients."""
        out = np.zeros(width)

        def walk(tree) -> None:
            if isinstance(tree, tuple):
                out[tree[0]] += 1
                walk(tree[2])
                walk(tree[3])

        for tree in self.trees:
            if self.linear:
                out += tree[1:]
            else:
                walk(tree)
        return np.abs(out)

    def add(self, x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> None:
        """One round on rows' gradients and curvatures."""
        if self.linear:
            z = np.column_stack([np.ones(len(x)), x])
            gram = z.T @ (hess[:, None] * z) + self.l2 * np.diag(np.r_[0.0, np.ones(x.shape[1])]) + 1e-9 * np.eye(z.shape[1])
            self.trees.append(-self.rate * np.linalg.solve(gram, z.T @ grad))
            return
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]) if x.shape[1] else np.zeros((len(x), 0), int)
        self.trees.append(self._grow(codes, edges, grad, hess, self.depth))

    def _apply(self, tree, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            out[rows] += tree
            return
        j, value, low, high = tree
        left = x[rows, j] <= value
        self._apply(low, x, rows[left], out)
        self._apply(high, x, rows[~left], out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            if self.linear:
                out += tree[0] + x @ tree[1:]
            else:
                self._apply(tree, x, np.arange(len(x)), out)
        return out


def loss_slopes(y: np.ndarray, v: np.ndarray, kind: str, delta: float = 1.0, eps: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    u = v - y
    if kind == "mse":
        return u, np.ones(len(y))
    if kind == "huber":
        s = np.sqrt(1 + (u / delta) ** 2)
        return u / s, 1 / s**3
    h, a = np.maximum(v, eps), np.maximum(y, eps)
    return (h - a) / h**2, (2 * a - h) / h**3


def gate_slopes(y: np.ndarray, r2: np.ndarray, margin: np.ndarray, v0: float, kind: str = "mse") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forecasts, and gradient and Gauss-Newton curvature of the loss by each row's margin, through the recursion backwards."""
    gate = sigmoid(margin)
    before, after = states(r2, gate, v0), smooth(r2, gate, v0)
    e, w = loss_slopes(y, after, kind)
    move = (r2 - before) * gate * (1 - gate)
    grad, hess, pull, weight = np.empty(len(y)), np.empty(len(y)), 0.0, 0.0
    for t in range(len(y) - 1, -1, -1):
        pull, weight = pull + e[t], weight + w[t]
        grad[t], hess[t] = pull * move[t], max(weight * move[t] ** 2, 1e-12)
        pull, weight = (1 - gate[t]) * pull, (1 - gate[t]) ** 2 * weight
    return after, grad, hess


@dataclass
class BoostedSmoother:
    """A smoothing gate whose margin is a booster's, learned end to end; a validation tail stops early and restores the best round."""

    rounds: int = 100
    loss: str = "mse"
    window: int = 500
    valid: float = 0.1
    patience: int = 10
    booster: dict = field(default_factory=dict)
    base: float = -2.0

    init: Any = None

    def start(self, x: np.ndarray) -> np.ndarray:
        """The margins from which the trees start: those of the gates of ``init``, any object with gates(x) between 0 and 1, or ``base``."""
        if self.init is None:
            return np.full(len(x), self.base)
        gates = np.asarray(self.init.gates(x), float)
        if gates.shape != (len(x),) or not ((gates > 0) & (gates < 1)).all():
            raise ValueError("an initialiser must give a gate between 0 and 1 for each row")
        return np.log(gates / (1 - gates))

    def fit(self, x: np.ndarray, y: np.ndarray, returns: np.ndarray) -> BoostedSmoother:
        r2, cut = returns**2, len(y) - int(self.valid * len(y))
        self.v0, self.model = initial_variance(r2, self.window), Booster(**self.booster)
        start, best, keep, self.history = self.start(x), np.inf, 0, []
        margin = start
        for k in range(1, self.rounds + 1):
            _, grad, hess = gate_slopes(y[:cut], r2[:cut], margin[:cut], self.v0, self.loss)
            scale = 1 / max(np.mean(hess), 1e-300)
            self.model.add(x[:cut], grad * scale, hess * scale)
            margin = start + self.model.predict(x)
            v = smooth(r2, sigmoid(margin), self.v0)
            watched = score(y[cut:], v[cut:], "mse" if self.loss == "huber" else self.loss) if cut < len(y) else score(y, v, "mse" if self.loss == "huber" else self.loss)
            self.history.append(watched)
            if watched < best:
                best, keep = watched, k
            elif cut < len(y) and k - keep >= self.patience:
                break
        if cut < len(y):
            self.model.trees = self.model.trees[:keep]
        return self

    def gates(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.start(x) + self.model.predict(x))

    def predict(self, x: np.ndarray, returns: np.ndarray, v0: float | None = None) -> np.ndarray:
        """Begins at the initial variance of the fit unless another is given."""
        return smooth(returns**2, self.gates(x), self.v0 if v0 is None else v0)


@dataclass
class WithConstant:
    """A fitted smoother whose columns begin with a constant, as an initialiser by the columns alone."""

    model: Any

    def gates(self, x: np.ndarray) -> np.ndarray:
        return self.model.gates(np.column_stack([np.ones(len(x)), x])[:, : len(self.model.columns)])


def alternate(x: np.ndarray, y: np.ndarray, returns: np.ndarray, rounds: int = 3, trees: int = 20, **booster) -> BoostedSmoother:
    """The older scheme: regress the best one-step gates on the features, run the filter, repeat."""
    r2 = returns**2
    out = BoostedSmoother(valid=0.0)
    out.v0, out.base, gate = initial_variance(r2), 0.0, np.full(len(y), 0.1)
    for _ in range(rounds):
        before = states(r2, gate, out.v0)
        move = r2 - before
        safe = np.where(np.abs(move) < 1e-12, 1.0, move)
        target = np.where(np.abs(move) < 1e-12, gate, np.clip((y - before) / safe, 0, 1))
        out.model, margin = Booster(**booster), np.zeros(len(y))
        for _ in range(trees):
            p = sigmoid(margin)
            out.model.add(x, p - target, np.maximum(p * (1 - p), 1e-6))
            margin = out.model.predict(x)
        gate = sigmoid(margin)
    return out
