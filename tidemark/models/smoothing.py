"""Exponential smoothing with a constant or a smooth-transition gate: fit, cross-validation, adaptive penalties."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.text import schema_hash
from ..operators.recursion import smooth
from ..operators.store import check_columns
from .optim import lbfgs, least_squares


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def path_with_slopes(x: np.ndarray, r2: np.ndarray, beta: np.ndarray, v0: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gate, forecasts, and the forecasts' derivatives by beta, in one forward pass."""
    gate = sigmoid(x @ beta)
    out, slopes = np.empty(len(r2)), np.empty(x.shape)
    v, d = (r2[0] if v0 is None else v0), np.zeros(x.shape[1])
    turn = gate * (1 - gate)
    for t in range(len(r2)):
        d = turn[t] * (r2[t] - v) * x[t] + (1 - gate[t]) * d
        v = gate[t] * r2[t] + (1 - gate[t]) * v
        out[t], slopes[t] = v, d
    return gate, out, slopes


def qlike_value(y: np.ndarray, v: np.ndarray, eps: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Row losses and their derivatives by v."""
    a, h = np.maximum(y, eps), np.maximum(v, eps)
    return a / h - np.log(a / h) - 1, np.where(v > eps, (h - a) / (h * h), 0.0)


def score(y: np.ndarray, v: np.ndarray, loss: str) -> float:
    return float(np.mean((y - v) ** 2)) if loss == "mse" else float(qlike_value(y, v)[0].mean())


@dataclass
class Smoother:
    """Gate sigmoid(x beta). A single constant column is exponential smoothing."""

    columns: list[str]
    loss: str = "mse"
    l2: float = 0.0
    entropy: float = 0.0
    weights: np.ndarray | None = None
    burn_in: int = 0
    restarts: int = 3
    seed: int = 0
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v0: float = 0.0
    last: float = 0.0

    def _free(self) -> np.ndarray:
        return np.array([c != "const" for c in self.columns], float)

    def objective(self, x: np.ndarray, y: np.ndarray, r2: np.ndarray):
        """For the squared loss a (residual, jacobian) function, else (value, gradient)."""
        at = slice(self.burn_in, None)
        free = self._free() * (1 if self.weights is None else self.weights)
        strength = np.sqrt(self.l2) * np.linalg.norm(y[at])

        def squares(beta: np.ndarray):
            _, v, d = path_with_slopes(x, r2, beta)
            return np.concatenate([y[at] - v[at], strength * free * beta]), np.vstack([-d[at], np.diag(strength * free)])

        def value(beta: np.ndarray):
            gate, v, d = path_with_slopes(x, r2, beta)
            rows, slope = qlike_value(y[at], v[at])
            total, grad = rows.sum() + 0.5 * (strength * free * beta) @ (strength * free * beta), slope @ d[at] + (strength * free) ** 2 * beta
            if self.entropy:
                a = np.clip(gate, 1e-12, 1 - 1e-12)
                total += self.entropy * np.mean(a * np.log(a) + (1 - a) * np.log1p(-a))
                grad = grad + self.entropy / len(a) * ((np.log(a) - np.log1p(-a)) * a * (1 - a)) @ x
            return float(total), grad

        return squares if self.loss == "mse" else value

    def fit(self, x: np.ndarray, y: np.ndarray, returns: np.ndarray) -> Smoother:
        """Best of the restarts from normal draws; the entropy term belongs to the quasi-likelihood loss only."""
        r2, g = returns**2, np.random.default_rng(self.seed)
        f = self.objective(x, y, r2)
        tries = [(least_squares if self.loss == "mse" else lbfgs)(f, g.standard_normal(x.shape[1])) for _ in range(self.restarts)]
        self.beta, self.train_loss = min(tries, key=lambda t: t[1])
        self.v0, self.last = float(r2[0]), float(smooth(r2, sigmoid(x @ self.beta))[-1])
        return self

    def predict(self, x: np.ndarray, returns: np.ndarray, v0: float | None = None) -> np.ndarray:
        return smooth(returns**2, self.gates(x), v0)

    def gates(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.beta)

    def guard(self, columns: list[str]) -> None:
        check_columns(self.columns, columns)

    def params(self) -> dict:
        return {"columns": self.columns, "beta": self.beta.tolist(), "last": self.last, "schema_hash": schema_hash(self.columns)}


def es_columns() -> list[str]:
    return ["const"]


def adaptive_weights(x: np.ndarray, y: np.ndarray, returns: np.ndarray, columns: list[str], ridge: float = 1e-3, gamma: float = 1.0, eps: float = 1e-6, **params) -> np.ndarray:
    """Penalty weights 1 / max(|beta|, eps) ** gamma of a ridge pilot."""
    pilot = Smoother(columns, l2=ridge, **params).fit(x, y, returns)
    return 1 / np.maximum(np.abs(pilot.beta), eps) ** gamma


def fold_score(x: np.ndarray, y: np.ndarray, returns: np.ndarray, train_to: int, val_to: int, model: Smoother, tail: int = 20) -> float:
    """Loss on [train_to, val_to) of a fit before it, begun from the mean of the last ``tail`` squared returns."""
    x = x[:, : len(model.columns)]
    model.fit(x[:train_to], y[:train_to], returns[:train_to])
    v0 = float(np.mean(returns[max(0, train_to - tail) : train_to] ** 2))
    v = model.predict(x[train_to:val_to], returns[train_to:val_to], v0)
    return score(y[train_to:val_to], v, model.loss)
