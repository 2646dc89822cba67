"""Small optimisers: damped least squares, limited-memory BFGS and Adam."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def least_squares(f: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], x0: np.ndarray, steps: int = 200, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Minimise |residual|^2 / 2 of ``f(x) -> (residual, jacobian)``; a step that does not lower it raises the damping."""
    x, damp = np.array(x0, float), 1e-3
    res, jac = f(x)
    cost = 0.5 * res @ res
    for _ in range(steps):
        gram, slope = jac.T @ jac, jac.T @ res
        if np.abs(slope).max(initial=0) < tol:
            break
        better = False
        while damp < 1e12:
            move = np.linalg.solve(gram + damp * (np.diag(np.diag(gram)) + 1e-12 * np.eye(len(x))), -slope)
            new_res, new_jac = f(x + move)
            new = 0.5 * new_res @ new_res
            if np.isfinite(new) and new < cost:
                better = cost - new > tol * max(cost, 1e-300)
                x, res, jac, cost, damp = x + move, new_res, new_jac, new, max(damp / 3, 1e-12)
                break
            damp *= 4
        if not better:
            break
    return x, float(cost)


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x0: np.ndarray, steps: int = 500, memory: int = 10, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Minimise ``f(x) -> (value, gradient)`` with backtracking until the value falls enough."""
    x = np.array(x0, float)
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(grad).max(initial=0) < tol:
            break
        q, kept = grad.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            kept.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        slope = -(grad @ q)
        if slope >= 0:
            q, slope, pairs = grad, -(grad @ grad), []
        size = 1.0 if pairs else min(1.0, 1 / np.abs(grad).sum())
        while size > 1e-14:
            new_value, new_grad = f(x - size * q)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = -size * q, new_grad - grad
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            pairs = [*pairs[1 - memory :], (s, y)] if memory > 1 else [(s, y)]
        done = value - new_value <= 1e-12 * max(abs(value), 1e-12)
        x, value, grad = x + s, new_value, new_grad
        if done:
            break
    return x, float(value)


def adam(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x0: np.ndarray, epochs: int = 200, rate: float = 0.02, decay: np.ndarray | float = 0.0, watch: Callable[[np.ndarray], float] | None = None, patience: int = 20) -> tuple[np.ndarray, float, int]:
    """Decoupled-decay Adam; with ``watch`` the best state by it is restored, and it stops after ``patience`` epochs without a better one."""
    x, m, v = np.array(x0, float), np.zeros(len(x0)), np.zeros(len(x0))
    best, best_x, at = np.inf, x.copy(), 0
    for t in range(1, epochs + 1):
        value, grad = f(x)
        score = value if watch is None else watch(x)
        if score < best - 1e-15:
            best, best_x, at = score, x.copy(), t
        elif watch is not None and t - at >= patience:
            break
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x = x - rate * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * x)
    return best_x, float(best), at
