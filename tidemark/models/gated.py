"""Gated recurrent variance: gate, candidate and state, with exact gradients through time."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from .optim import adam
from .smoothing import sigmoid


@dataclass
class GatedConfig:
    """gate: stes (features) or gru_linear (features and state); candidate: r2, linear_pos (of 1, r, |r|, r2, v) or mlp_pos (a tanh layer of these).

    ``reset``: a gate of features and state that scales the state within the candidate, which r2 does not have. ``positive``: what makes a
    candidate's score positive.
    """

    gate: str = "stes"
    candidate: str = "r2"
    reset: bool = False
    hidden: int = 8
    positive: str = "softplus"
    loss: str = "mse"
    states: int = 1
    epochs: int = 200
    rate: float = 0.02
    decay: float = 0.0
    stay_close: float = 0.0
    entropy: float = 0.0
    group_lasso: float = 0.0
    valid: float = 0.0
    patience: int = 20
    eps: float = 1e-12
    seed: int = 0

    def __post_init__(self) -> None:
        for name, allowed in (("gate", ("stes", "gru_linear")), ("candidate", ("r2", "linear_pos", "mlp_pos")), ("positive", ("softplus", "exp")), ("loss", ("mse", "nll", "qlike"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if min(self.states, self.epochs, self.hidden, self.patience) < 1 or not 0 <= self.valid < 1 or self.rate <= 0 or self.eps <= 0:
            raise ValueError("states, epochs, hidden, patience, rate and eps must be positive, valid in [0, 1)")
        if min(self.decay, self.stay_close, self.entropy, self.group_lasso) < 0:
            raise ValueError("penalties must not be negative")


@dataclass
class GatedVariance:
    config: GatedConfig = field(default_factory=GatedConfig)
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _shapes(self, p: int) -> dict[str, tuple[int, ...]]:
        """The parameters in the order in which ``theta`` holds them."""
        cfg, d = self.config, self.config.states
        out: dict[str, tuple[int, ...]] = {"beta": (p, d)}
        if cfg.gate == "gru_linear":
            out["w"] = (d,)
        if cfg.reset and cfg.candidate != "r2":
            out |= {"gamma": (p, d), "w_reset": (d,)}
        if cfg.candidate == "linear_pos":
            out["c"] = (5, d)
        if cfg.candidate == "mlp_pos":
            out |= {"a": (cfg.hidden, 3 + d), "a0": (cfg.hidden,), "b": (d, cfg.hidden), "b0": (d,)}
        return out

    def _parts(self, theta: np.ndarray, p: int) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self._shapes(p).items():
            size = int(np.prod(shape))
            out[name], at = theta[at : at + size].reshape(shape), at + size
        return out

    def _size(self, p: int) -> int:
        return sum(int(np.prod(shape)) for shape in self._shapes(p).values())

    def _positive(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A positive value and its slope by the score."""
        if self.config.positive == "exp":
            value = np.exp(np.clip(score, -50, 50))
            return value, value
        return np.logaddexp(0, score), sigmoid(score)

    def run(self, theta: np.ndarray, x: np.ndarray, r: np.ndarray, v0: np.ndarray) -> dict[str, np.ndarray]:
        k = self._parts(theta, x.shape[1])
        n, d = len(r), self.config.states
        out = {name: np.empty((n, d)) for name in ("before", "z", "cand", "slope", "v", "open", "s")}
        out["hid"] = np.empty((n, self.config.hidden))
        v, w, s = v0, k.get("w", np.zeros(d)), np.ones(d)
        for t in range(n):
            z = sigmoid(x[t] @ k["beta"] + w * v)
            if "gamma" in k:
                s = sigmoid(x[t] @ k["gamma"] + k["w_reset"] * v)
            if "c" in k:
                c = k["c"]
                cand, slope = self._positive(c[0] + c[1] * r[t] + c[2] * abs(r[t]) + c[3] * r[t] ** 2 + c[4] * s * v)
            elif "a" in k:
                out["hid"][t] = np.tanh(k["a"] @ np.r_[r[t], abs(r[t]), r[t] ** 2, s * v] + k["a0"])
                cand, slope = self._positive(k["b"] @ out["hid"][t] + k["b0"])
            else:
                cand, slope = np.full(d, r[t] ** 2), np.zeros(d)
            nxt = (1 - z) * v + z * cand
            for name, a in (("before", v), ("z", z), ("cand", cand), ("slope", slope), ("open", nxt > self.config.eps), ("s", s)):
                out[name][t] = a
            v = np.maximum(nxt, self.config.eps)
            out["v"][t] = v
        return out

    def losses(self, y: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        n = len(y)
        if self.config.loss == "mse":
            return float(np.mean((h - y) ** 2)), 2 * (h - y) / n
        if self.config.loss == "nll":
            return float(0.5 * np.mean(np.log(h) + y / h)), 0.5 * (1 / h - y / h**2) / n
        a = np.maximum(y, 1e-8)
        return float(np.mean(a / h - np.log(a / h) - 1)), (h - a) / h**2 / n

    def objective(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, v0: np.ndarray, reference: np.ndarray | None = None):
        cfg, p = self.config, x.shape[1]

        def f(theta: np.ndarray) -> tuple[float, np.ndarray]:
            s, k = self.run(theta, x, r, v0), self._parts(theta, p)
            value, dh = self.losses(y, s["v"].mean(1))
            g = {name: np.zeros_like(a) for name, a in k.items()}
            pull, w = np.zeros(cfg.states), k.get("w", np.zeros(cfg.states))
            if cfg.entropy:
                a = np.clip(s["z"], 1e-9, 1 - 1e-9)
                value += cfg.entropy * float(np.mean(a * np.log(a) + (1 - a) * np.log1p(-a)))
            for t in range(len(r) - 1, -1, -1):
                pull = (pull + dh[t] / cfg.states) * s["open"][t]
                z, v, gate = s["z"][t], s["before"][t], s["s"][t]
                dz = pull * (s["cand"][t] - v)
                if cfg.entropy:
                    a = np.clip(z, 1e-9, 1 - 1e-9)
                    dz = dz + cfg.entropy * (np.log(a) - np.log1p(-a)) / s["z"].size
                ds = dz * z * (1 - z)
                g["beta"] += np.outer(x[t], ds)
                if "w" in g:
                    g["w"] += ds * v
                back, inner = pull * (1 - z) + ds * w, np.zeros(cfg.states)
                score = pull * z * s["slope"][t]
                if "c" in k:
                    g["c"] += np.stack([score, score * r[t], score * abs(r[t]), score * r[t] ** 2, score * gate * v])
                    inner = score * k["c"][4]
                elif "a" in k:
                    hid = s["hid"][t]
                    g["b"] += np.outer(score, hid)
                    g["b0"] += score
                    layer = (k["b"].T @ score) * (1 - hid * hid)
                    g["a"] += np.outer(layer, np.r_[r[t], abs(r[t]), r[t] ** 2, gate * v])
                    g["a0"] += layer
                    inner = k["a"][:, 3:].T @ layer
                if "gamma" in k:
                    turn = inner * v * gate * (1 - gate)
                    g["gamma"] += np.outer(x[t], turn)
                    g["w_reset"] += turn * v
                    back = back + turn * k["w_reset"]
                pull = back + inner * gate
            beta, g_beta = k["beta"], g["beta"]
            if cfg.stay_close and reference is not None:
                value += cfg.stay_close * float(((beta - reference) ** 2).sum())
                g_beta += 2 * cfg.stay_close * (beta - reference)
            if cfg.group_lasso:
                norm = np.sqrt((beta**2).sum(1, keepdims=True) + 1e-12)
                value += cfg.group_lasso * float(norm.sum())
                g_beta += cfg.group_lasso * beta / norm
            return value, np.concatenate([a.ravel() for a in g.values()])

        return f

    def fit(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, start: np.ndarray | None = None) -> GatedVariance:
        cfg, cut = self.config, len(y) - int(self.config.valid * len(y))
        self.v0 = np.full(cfg.states, max(float(np.mean(r[: max(20, 1)] ** 2)), cfg.eps))
        theta = np.random.default_rng(cfg.seed).normal(0, 0.1, self._size(x.shape[1]))
        reference = None
        if start is not None:
            reference = np.repeat(np.asarray(start, float)[:, None], cfg.states, 1)
            theta[: reference.size] = reference.ravel()
        f = self.objective(x[:cut], y[:cut], r[:cut], self.v0, reference)
        watch = None
        if cut < len(y):
            watch = lambda t: self.losses(y[cut:], self.run(t, x, r, self.v0)["v"].mean(1)[cut:])[0]
        self.theta, self.train_loss, self.epochs = adam(f, theta, cfg.epochs, cfg.rate, cfg.decay, watch, cfg.patience)
        return self

    def predict(self, x: np.ndarray, r: np.ndarray, v0: np.ndarray | float | None = None) -> np.ndarray:
        start = self.v0 if v0 is None else np.broadcast_to(np.asarray(v0, float), (self.config.states,))
        return self.run(self.theta, x, r, start)["v"].mean(1)

    def gates(self, x: np.ndarray, r: np.ndarray) -> np.ndarray:
        return self.run(self.theta, x, r, self.v0)["z"]


def after_validation(config: GatedConfig, epochs: list[int]) -> GatedConfig:
    """The configuration for the fit on all rows: as many epochs as the folds took on average, none held back."""
    return replace(config, valid=0.0, epochs=max(1, round(float(np.mean(epochs)))))


def from_smoother(beta: np.ndarray, v0: float) -> GatedVariance:
    """The gated model that equals a smooth-transition smoother."""
    out = GatedVariance(theta=np.asarray(beta, float))
    out.v0 = np.array([v0])
    return out
