"""Recurrent networks over the features: a variance of their own, or the gate of a smoother; exact gradients through time."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .optim import adam
from .smoothing import qlike_value, sigmoid


@dataclass
class Recurrent:
    """cell: rnn (tanh) or gru. head: variance (softplus of the state) or gate (of r2 against the last variance)."""

    cell: str = "gru"
    head: str = "variance"
    hidden: int = 6
    loss: str = "mse"
    epochs: int = 100
    rate: float = 0.02
    decay: float = 0.0
    valid: float = 0.0
    patience: int = 10
    seed: int = 0
    eps: float = 1e-8
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        if self.cell not in ("rnn", "gru") or self.head not in ("variance", "gate") or self.loss not in ("mse", "qlike"):
            raise ValueError("cell is rnn or gru, head variance or gate, loss mse or qlike")
        if min(self.hidden, self.epochs) < 1 or not 0 <= self.valid < 1:
            raise ValueError("hidden and epochs must be positive, valid in [0, 1)")

    def _shapes(self, p: int) -> list[tuple[int, ...]]:
        k, h = 3 if self.cell == "gru" else 1, self.hidden
        return [(k, h, p), (k, h, h), (k, h), (h,), (1,)]

    def _parts(self, theta: np.ndarray, p: int) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self._shapes(p):
            size = int(np.prod(shape))
            out.append(theta[at : at + size].reshape(shape))
            at += size
        return out

    def _size(self, p: int) -> int:
        return sum(int(np.prod(s)) for s in self._shapes(p))

    def run(self, theta: np.ndarray, x: np.ndarray, r: np.ndarray, v0: float) -> dict[str, np.ndarray]:
        wx, wh, b, u, c = self._parts(theta, x.shape[1])
        n, h = len(x), np.zeros(self.hidden)
        s = {k: np.empty((n, self.hidden)) for k in ("before", "h", "keep", "reset", "new", "inner")} | {k: np.empty(n) for k in ("score", "v", "last")}
        v = v0
        for t in range(n):
            s["before"][t], s["last"][t] = h, v
            if self.cell == "gru":
                keep, reset = (sigmoid(wx[k] @ x[t] + wh[k] @ h + b[k]) for k in (0, 1))
                inner = wh[2] @ h
                new = np.tanh(wx[2] @ x[t] + reset * inner + b[2])
                h = (1 - keep) * new + keep * h
                s["keep"][t], s["reset"][t], s["new"][t], s["inner"][t] = keep, reset, new, inner
            else:
                h = np.tanh(wx[0] @ x[t] + wh[0] @ h + b[0])
            s["h"][t], s["score"][t] = h, u @ h + c[0]
            if self.head == "gate":
                a = sigmoid(s["score"][t])
                v = a * r[t] ** 2 + (1 - a) * v
            else:
                v = float(np.logaddexp(0, s["score"][t])) + self.eps
            s["v"][t] = v
        return s

    def objective(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, v0: float):
        p = x.shape[1]

        def f(theta: np.ndarray) -> tuple[float, np.ndarray]:
            wx, wh, _, u, _ = self._parts(theta, p)
            s, n = self.run(theta, x, r, v0), len(y)
            if self.loss == "mse":
                value, dv = float(np.mean((s["v"] - y) ** 2)), 2 * (s["v"] - y) / n
            else:
                rows, slope = qlike_value(y, s["v"], self.eps)
                value, dv = float(rows.mean()), slope / n
            grads = [np.zeros(shape) for shape in self._shapes(p)]
            pull, through = np.zeros(self.hidden), 0.0
            for t in range(n - 1, -1, -1):
                if self.head == "gate":
                    a = sigmoid(s["score"][t])
                    through += dv[t]
                    score, through = through * (r[t] ** 2 - s["last"][t]) * a * (1 - a), through * (1 - a)
                else:
                    score = dv[t] * sigmoid(s["score"][t])
                grads[3] += score * s["h"][t]
                grads[4] += score
                pull = pull + score * u
                h = s["before"][t]
                if self.cell == "gru":
                    keep, reset, new, inner = (s[k][t] for k in ("keep", "reset", "new", "inner"))
                    d_new = pull * (1 - keep) * (1 - new * new)
                    d = (pull * (h - new) * keep * (1 - keep), d_new * inner * reset * (1 - reset), d_new)
                    back = pull * keep + wh[2].T @ (d_new * reset)
                    grads[1][2] += np.outer(d_new * reset, h)
                    for k in (0, 1):
                        grads[1][k] += np.outer(d[k], h)
                        back = back + wh[k].T @ d[k]
                else:
                    d = (pull * (1 - s["h"][t] ** 2),)
                    grads[1][0] += np.outer(d[0], h)
                    back = wh[0].T @ d[0]
                for k, g in enumerate(d):
                    grads[0][k] += np.outer(g, x[t])
                    grads[2][k] += g
                pull = back
            return value, np.concatenate([g.ravel() for g in grads])

        return f

    def fit(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> Recurrent:
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        z, cut = (x - self.mean) / self.scale, len(y) - int(self.valid * len(y))
        self.v0 = max(float(np.mean(r[:20] ** 2)), self.eps)
        start = np.random.default_rng(self.seed).normal(0, 0.2, self._size(x.shape[1]))
        if self.head == "variance":
            level = max(float(np.mean(y)), 1e-6)
            start[-1] = level + np.log(-np.expm1(-level))
        else:
            start[-1] = -2.0
        watch = None
        if cut < len(y):
            watch = lambda t: float(np.mean((self.run(t, z, r, self.v0)["v"][cut:] - y[cut:]) ** 2))
        self.theta, self.train_loss, self.best_epoch = adam(self.objective(z[:cut], y[:cut], r[:cut], self.v0), start, self.epochs, self.rate, self.decay, watch, self.patience)
        return self

    def predict(self, x: np.ndarray, r: np.ndarray, v0: float | None = None) -> np.ndarray:
        return self.run(self.theta, (x - self.mean) / self.scale, r, self.v0 if v0 is None else v0)["v"]

    def gates(self, x: np.ndarray, r: np.ndarray) -> np.ndarray:
        if self.head != "gate":
            raise ValueError("only a gate head has gates")
        return sigmoid(self.run(self.theta, (x - self.mean) / self.scale, r, self.v0)["score"])
