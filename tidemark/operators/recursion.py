"""Ordered variance recursions: one pass over each entity's rows, in Arrow batches of whole groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import Scan, affine, composed, scan_by


def per_group(df: DataFrame, by: Sequence[str], order: Sequence[str], outputs: Sequence[str], step: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """``df`` with double columns ``outputs``, which ``step`` makes from a group's rows in order. NaN comes back as null."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in outputs] + [T.StructField(c, T.DoubleType()) for c in outputs])
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in outputs]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order), ignore_index=True)
        return group.assign(**step(group))[schema.names]

    out = df.groupBy(*by).applyInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in [*outputs, *numeric]})


def smooth(r2: np.ndarray, gate: np.ndarray | float, v0: float | None = None) -> np.ndarray:
    """Forecasts v_(t+1) = gate_t r2_t + (1 - gate_t) v_t from v_0 = r2_0 or as given."""
    gate = np.broadcast_to(np.asarray(gate, float), r2.shape)
    out = np.empty(len(r2))
    v = (r2[0] if len(r2) else 0.0) if v0 is None else v0
    for t, (a, x) in enumerate(zip(gate.tolist(), r2.tolist(), strict=True)):
        v = a * x + (1 - a) * v
        out[t] = v
    return out


def initial_variance(r2: np.ndarray, window: int = 500, least: float = 1e-8) -> float:
    head = r2[:window]
    head = head[~np.isnan(head)]
    return max(float(head.mean()), least) if len(head) else least


def states(r2: np.ndarray, gate: np.ndarray | float, v0: float) -> np.ndarray:
    """The variance before each row's return is known."""
    return np.concatenate([[v0], smooth(r2, gate, v0)[:-1]]) if len(r2) else np.zeros(0)


def ewma(x: np.ndarray, half_life: float, state: float = np.nan, missing: float = 0) -> np.ndarray:
    """s_t = (1 - a) s_(t-1) + a x_t from the first value, or from a state that so many missing values followed; a missing value repeats the state and lets its weight decay."""
    a = 1 - 2 ** (-1 / half_life)
    out, s, weight = np.full(len(x), np.nan), state, (1 - a) ** missing
    for t, v in enumerate(x.tolist()):
        if v == v:
            if s != s:
                s = v
            else:
                weight *= 1 - a
                s = (weight * s + a * v) / (weight + a)
            weight = 1.0
        elif s == s:
            weight *= 1 - a
        out[t] = s
    return out


def ewma_map(x: np.ndarray, half_life: float) -> np.ndarray:
    """What a block of values does to (state, missing values behind it): values missing before its first, that value, slope and shift of what follows, values missing behind its last."""
    a, at = 1 - 2 ** (-1 / half_life), np.flatnonzero(~np.isnan(x))
    if not len(at):
        return np.array([len(x), np.nan, 1.0, 0.0, len(x)])
    weight = (1 - a) ** np.diff(at)
    slope, shift, _ = composed(weight / (weight + a), a * x[at[1:]] / (weight + a))
    return np.array([at[0], x[at[0]], slope, shift, len(x) - 1 - at[-1]])


def ewma_advance(state: np.ndarray, does: np.ndarray, half_life: float) -> np.ndarray:
    (s, missing), (before, first, slope, shift, behind) = state, does
    if first != first:
        return np.array([s, missing + before])
    a = 1 - 2 ** (-1 / half_life)
    weight = (1 - a) ** (missing + before + 1)
    s = first if s != s else (weight * s + a * first) / (weight + a)
    return np.array([slope * s + shift, behind])


def pgarch(y: np.ndarray, mu: np.ndarray, phi: np.ndarray, g: np.ndarray, h0: float | None = None, least: float = 1e-12) -> np.ndarray:
    """h_t from row t - 1: max((1 - phi) mu + phi (g y + (1 - g) h), least), from h_0 = y_0."""
    n = len(y)
    mu, phi, g = (np.broadcast_to(np.asarray(x, float), n) for x in (mu, phi, g))
    h = np.empty(n)
    if n:
        h[0] = max(y[0] if h0 is None else h0, least)
    for t in range(n - 1):
        h[t + 1] = max((1 - phi[t]) * mu[t] + phi[t] * (g[t] * y[t] + (1 - g[t]) * h[t]), least)
    return h


def garch(r: np.ndarray, omega: float, alpha: float, beta: float, h0: float | None = None) -> np.ndarray:
    h = np.empty(len(r))
    if len(r):
        h[0] = np.mean(r * r) if h0 is None else h0
    for t in range(len(r) - 1):
        h[t + 1] = omega + alpha * r[t] * r[t] + beta * h[t]
    return h


def adjoint(u: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """lambda_t = u_t + rho_t lambda_(t+1), from behind."""
    out, last = np.zeros(len(u)), 0.0
    for t in range(len(u) - 1, -1, -1):
        last = u[t] + rho[t] * last
        out[t] = last
    return out


def future_weight(w: np.ndarray, rho: np.ndarray) -> np.ndarray:
    return adjoint(w, rho * rho)


def gated(r: np.ndarray, x: np.ndarray, beta: np.ndarray, v0: np.ndarray, state_weight: np.ndarray | None = None, candidate: Callable[[float, np.ndarray], np.ndarray] | None = None, least: float = 1e-12) -> np.ndarray:
    """Forecasts of a gated recurrent variance of d states: z = sigmoid(x beta + w v), v' = max((1 - z) v + z c, least), their mean."""
    v, out = np.array(v0, float), np.empty(len(r))
    for t in range(len(r)):
        score = x[t] @ beta + (0 if state_weight is None else state_weight * v)
        z = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        c = r[t] * r[t] if candidate is None else candidate(r[t], v)
        v = np.maximum((1 - z) * v + z * c, least)
        out[t] = v.mean()
    return out


def _values(group: pd.DataFrame, column: str) -> np.ndarray:
    return group[column].to_numpy(float)


def smooth_by(df: DataFrame, returns: str, gate: str | float, out: str = "yhat", by: Sequence[str] = ("entity_id",), time: str = "ts_utc", v0: float | None = None, block_rows: int | None = None) -> DataFrame:
    """Exponential smoothing with a constant gate or the gate of a column.

    A series is one group, or with ``block_rows`` groups of about so many rows (here and below): for series that are too long for a task.
    """
    gates = lambda g: np.full(len(g), gate) if isinstance(gate, float) else _values(g, gate)
    if block_rows is None:
        return per_group(df, by, [time], [out], lambda g: {out: smooth(_values(g, returns) ** 2, gates(g), v0)})
    squares = lambda g: _values(g, returns) ** 2
    steps = affine(lambda g: (1 - gates(g), gates(g) * squares(g)), lambda h: h[0] if v0 is None else v0, squares, lambda g, v: {out: smooth(squares(g), gates(g), v)})
    return scan_by(df, steps, [out], by, [time], block_rows)


def filter_by(df: DataFrame, returns: str, gate: str | float, by: Sequence[str] = ("entity_id",), time: str = "ts_utc", window: int = 500, block_rows: int | None = None) -> DataFrame:
    """State and forecast of the filter that begins at the mean of the first ``window`` squared returns."""
    gates = lambda g: np.full(len(g), gate) if isinstance(gate, float) else _values(g, gate)
    squares = lambda g: _values(g, returns) ** 2
    fill = lambda g, v: {"state": states(squares(g), gates(g), v), "yhat": smooth(squares(g), gates(g), v)}
    if block_rows is None:
        return per_group(df, by, [time], ["state", "yhat"], lambda g: fill(g, initial_variance(squares(g), window)))
    steps = affine(lambda g: (1 - gates(g), gates(g) * squares(g)), lambda h: initial_variance(h, window), squares, fill, window)
    return scan_by(df, steps, ["state", "yhat"], by, [time], block_rows)


def ewma_by(df: DataFrame, columns: Sequence[str], half_lives: Sequence[float], by: Sequence[str] = ("entity_id",), time: str = "ts_utc", block_rows: int | None = None) -> DataFrame:
    names = {f"ewma.{c}.hl={h:g}": (c, h) for c in columns for h in half_lives}
    if block_rows is None:
        return per_group(df, by, [time], list(names), lambda g: {n: ewma(_values(g, c), h) for n, (c, h) in names.items()})
    each = list(names.values())
    steps = Scan(
        lambda g: np.concatenate([ewma_map(_values(g, c), h) for c, h in each]),
        lambda state, does: np.concatenate([ewma_advance(state[2 * k : 2 * k + 2], does[5 * k : 5 * k + 5], h) for k, (_, h) in enumerate(each)]),
        lambda _: np.tile([np.nan, 0.0], len(each)),
        lambda g, state: {n: ewma(_values(g, c), h, *state[2 * k : 2 * k + 2]) for k, (n, (c, h)) in enumerate(names.items())},
        lambda g: np.zeros(1),
    )
    return scan_by(df, steps, list(names), by, [time], block_rows)


def pgarch_by(df: DataFrame, y: str, mu: str | float, phi: str | float, g: str | float, by: Sequence[str] = ("entity_id",), time: str = "ts_utc", least: float = 1e-12, block_rows: int | None = None) -> DataFrame:
    part = lambda group, x: np.full(len(group), x) if isinstance(x, float) else _values(group, x)
    if block_rows is None:
        return per_group(df, by, [time], ["h"], lambda d: {"h": pgarch(_values(d, y), part(d, mu), part(d, phi), part(d, g), least=least)})

    def maps(d: pd.DataFrame) -> tuple:
        m, p, k = part(d, mu), part(d, phi), part(d, g)
        return p * (1 - k), (1 - p) * m + p * k * _values(d, y), least

    steps = affine(maps, lambda h: max(h[0], least), lambda d: _values(d, y), lambda d, v: {"h": pgarch(_values(d, y), part(d, mu), part(d, phi), part(d, g), v, least)})
    return scan_by(df, steps, ["h"], by, [time], block_rows)


def garch_by(df: DataFrame, returns: str, omega: float, alpha: float, beta: float, h0: float, by: Sequence[str] = ("entity_id",), time: str = "ts_utc", block_rows: int | None = None) -> DataFrame:
    if block_rows is None:
        return per_group(df, by, [time], ["h"], lambda d: {"h": garch(_values(d, returns), omega, alpha, beta, h0)})
    squares = lambda d: _values(d, returns) ** 2
    steps = affine(lambda d: (np.full(len(d), beta), omega + alpha * squares(d)), lambda _: h0, squares, lambda d, v: {"h": garch(_values(d, returns), omega, alpha, beta, v)})
    return scan_by(df, steps, ["h"], by, [time], block_rows)


def last_ewma(df: DataFrame, value: str, half_life: float, by: str, time: str) -> DataFrame:
    """The state after the last row of each group, in generated code: a fold over the group's ordered rows."""
    a = 1 - 2 ** (-1 / half_life)
    rows = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("x"))))
    fold = F.aggregate(F.slice(rows, 2, F.size(rows)), rows[0]["x"], lambda s, r: (1 - a) * s + a * r["x"])
    return df.groupBy(by).agg(fold.alias("state"), F.count("*").alias("n"))


def adjoint_by(df: DataFrame, u: str, rho: str, by: Sequence[str] = ("entity_id",), time: str = "ts_utc", block_rows: int | None = None) -> DataFrame:
    """The backward pull of each row, and the weight that later rows give it."""
    if block_rows is None:
        step = lambda g: {"pull": adjoint(_values(g, u), _values(g, rho)), "weight": future_weight(np.ones(len(g)), _values(g, rho))}
        return per_group(df, by, [time], ["pull", "weight"], step)

    def fill(g: pd.DataFrame, state: np.ndarray) -> dict[str, np.ndarray]:  # rows come from behind
        (pull, weight), r = state, _values(g, rho)
        out = np.empty((2, len(g)))
        for t, (x, p) in enumerate(zip(_values(g, u).tolist(), r.tolist(), strict=True)):
            pull, weight = x + p * pull, 1 + p * p * weight
            out[:, t] = pull, weight
        return {"pull": out[0], "weight": out[1]}

    steps = Scan(
        lambda g: np.concatenate([composed(_values(g, rho), _values(g, u))[:2], composed(_values(g, rho) ** 2, np.ones(len(g)))[:2]]),
        lambda state, does: does[[0, 2]] * state + does[[1, 3]], lambda _: np.zeros(2), fill, lambda g: np.zeros(1),
    )
    return scan_by(df, steps, ["pull", "weight"], by, [time], block_rows, reverse=True)
