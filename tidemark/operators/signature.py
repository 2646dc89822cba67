"""Path signatures by Chen's identity, per row over the array of a rolling path."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import recursion, windows


def augment(path: np.ndarray, steps: Sequence[str]) -> np.ndarray:
    """(n, time, channel) paths through augmentations in their order."""
    for s in steps:
        n, length, width = path.shape
        if s == "cumsum":
            path = np.cumsum(path, axis=1)
        elif s == "basepoint":
            path = np.concatenate([np.zeros((n, 1, width)), path], axis=1)
        elif s == "addtime":
            path = np.concatenate([np.broadcast_to(np.linspace(0, 1, length)[None, :, None], (n, length, 1)), path], axis=2)
        elif s == "leadlag":
            twice = np.repeat(path, 2, axis=1)
            path = np.concatenate([twice[:, 1:], twice[:, :-1]], axis=2)
        elif s == "ir":  # the start stays visible: up to the first point and a mark that falls to 0
            zero = np.zeros((n, 1, width))
            path = np.concatenate([zero, path[:, :1], path], axis=1)
            mark = np.ones((n, length + 2, 1))
            mark[:, 0] = 0
            path = np.concatenate([path, mark], axis=2)
        else:
            raise ValueError(f"unknown augmentation {s!r}")
    return path


def signature(path: np.ndarray, depth: int) -> np.ndarray:
    """Levels 1 .. depth of each path, flat: products of the exponentials of its steps."""
    n, length, width = path.shape
    total = [np.zeros((n, width**k)) for k in range(1, depth + 1)]
    for t in range(length - 1):
        step = path[:, t + 1] - path[:, t]
        powers = [step]
        for k in range(2, depth + 1):
            powers.append((powers[-1][:, :, None] * step[:, None, :]).reshape(n, -1) / k)
        fresh = []
        for k in range(depth):
            term = total[k] + powers[k]
            for j in range(k):
                term = term + (total[j][:, :, None] * powers[k - 1 - j][:, None, :]).reshape(n, -1)
            fresh.append(term)
        total = fresh
    return np.concatenate(total, axis=1)


def by_level(flat: np.ndarray, width: int, depth: int) -> list[np.ndarray]:
    """The levels of flat signatures, level k with width ** k words."""
    ends = np.cumsum([width**k for k in range(1, depth + 1)])
    return np.split(flat, ends[:-1], axis=1)


def rescaled(flat: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Signatures with level k times k!, so that the levels of one path are of one size."""
    return np.concatenate([math.factorial(k) * x for k, x in enumerate(by_level(flat, width, depth), 1)], axis=1)


def tensor_log(path: np.ndarray, depth: int) -> list[np.ndarray]:
    """The levels of the tensor logarithm of the signature, in all words."""
    n, _, width = path.shape
    levels = by_level(signature(path, depth), width, depth)
    out, power = [x.copy() for x in levels], [x.copy() for x in levels]
    for m in range(2, depth + 1):
        power = [sum(((power[j][:, :, None] * levels[k - 1 - j][:, None, :]).reshape(n, -1) for j in range(k)), np.zeros_like(levels[k])) for k in range(depth)]
        out = [o + (-1) ** (m + 1) / m * p for o, p in zip(out, power, strict=True)]
    return out


Word = tuple[int, ...]


def lyndon_words(width: int, depth: int) -> list[Word]:
    """Words of at most ``depth`` letters below ``width`` that are less than all their rotations, in order within each length."""
    found: list[Word] = []
    word = [-1]
    while word:
        word[-1] += 1
        found.append(tuple(word))
        size = len(word)
        word = [word[k % size] for k in range(depth)]
        while word and word[-1] == width - 1:
            word.pop()
    return sorted(found, key=lambda w: (len(w), w))


@functools.cache
def bracket(word: Word) -> dict[Word, int]:
    """The Lie polynomial of a Lyndon word: the commutator of those of the two Lyndon words into which it falls, the second as long as can be."""
    if len(word) == 1:
        return {word: 1}
    cut = next(k for k in range(1, len(word)) if all(word[k:] < word[j:] for j in range(k + 1, len(word))))
    left, right, out = bracket(word[:cut]), bracket(word[cut:]), {}
    for a, x in left.items():
        for b, y in right.items():
            out[a + b] = out.get(a + b, 0) + x * y
            out[b + a] = out.get(b + a, 0) - x * y
    return {w: c for w, c in out.items() if c}


@functools.lru_cache(maxsize=64)
def lie_basis(width: int, depth: int) -> list[tuple[list[Word], np.ndarray, np.ndarray]]:
    """For each level: its Lyndon words, their places among all words, and the matrix that turns the coefficients there into those of the brackets.

    A Lyndon word's bracket is the word itself and greater ones, so that the brackets' coefficients at the Lyndon words are a
    triangular matrix with ones: an element of the free Lie algebra is known from its coefficients there.
    """
    words, out = lyndon_words(width, depth), []
    for level in range(1, depth + 1):
        own = [w for w in words if len(w) == level]
        place = {w: k for k, w in enumerate(own)}
        at = np.array([functools.reduce(lambda x, letter: x * width + letter, w, 0) for w in own], np.int64)
        turn = np.eye(len(own))
        for k, w in enumerate(own):
            for other, c in bracket(w).items():
                if other in place:
                    turn[place[other], k] = c
        out.append((own, at, np.linalg.inv(turn)))
    return out


def log_signature(path: np.ndarray, depth: int) -> np.ndarray:
    """The logarithm of the signature in the basis of the free Lie algebra that the Lyndon words' brackets make, flat, level by level.

    As many terms as are independent (``lie_terms``); of level 2 they are the areas between channels i < j.
    """
    levels = tensor_log(path, depth)
    return np.concatenate([x[:, at] @ turn.T for x, (_, at, turn) in zip(levels, lie_basis(path.shape[2], depth), strict=True)], axis=1)


def terms(width: int, depth: int) -> int:
    return sum(width**k for k in range(1, depth + 1))


def lie_terms(width: int, depth: int) -> int:
    """Dimension of the free Lie algebra up to ``depth``, by Witt's formula."""

    def moebius(n: int) -> int:
        sign, k = 1, 2
        while n > 1:
            if n % k == 0:
                n //= k
                if n % k == 0:
                    return 0
                sign = -sign
            k += 1
        return sign

    return sum(sum(moebius(m) * width ** (k // m) for m in range(1, k + 1) if k % m == 0) // k for k in range(1, depth + 1))


def _width(channels: int, steps: Sequence[str]) -> int:
    for s in steps:
        channels = channels + 1 if s in ("addtime", "ir") else 2 * channels if s == "leadlag" else channels
    return channels


def features(df: DataFrame, columns: Sequence[str], lags: int, depth: int = 3, steps: Sequence[str] = ("cumsum", "basepoint", "addtime", "leadlag"), log: bool = False, prefix: str = "sig", rescale: bool = True) -> DataFrame:
    """``df`` with columns ``<prefix>.term=j`` of the path of the last lags + 1 values; null while the path is not whole.

    Terms are those of the signature in all words, level k times k! unless ``rescale`` is false, or with ``log`` those of its
    logarithm in the Lyndon basis, which is never rescaled.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth must be 1 to 5")
    width = _width(len(columns), steps)
    count = lie_terms(width, depth) if log else terms(width, depth)
    paths = [windows.path(c, lags) for c in columns]
    whole = paths[0].isNotNull()
    for p in paths[1:]:
        whole = whole & p.isNotNull()

    @F.pandas_udf("array<double>")
    def run(flat: pd.Series) -> pd.Series:
        ok = flat.notna().to_numpy()
        out: list[np.ndarray | None] = [None] * len(flat)
        if ok.any():
            x = augment(np.stack(flat[ok].to_list()).reshape(ok.sum(), len(columns), lags + 1).transpose(0, 2, 1), steps)
            made = log_signature(x, depth) if log else rescaled(signature(x, depth), width, depth) if rescale else signature(x, depth)
            for i, s in zip(np.flatnonzero(ok), made, strict=True):
                out[i] = s
        return pd.Series(out, dtype=object)

    rows = df.withColumn("_p", F.when(whole, F.flatten(F.array(*paths)))).withColumn("_s", run("_p"))
    return rows.select(*df.columns, *(F.get("_s", F.lit(j)).alias(f"{prefix}.term={j}") for j in range(count)))


def depth2(path: Column) -> dict[str, Column]:
    """Closed form for one channel and no augmentation: S1 = x_L - x_0, S11 = S1^2 / 2."""
    move = F.element_at(path, -1) - F.element_at(path, 1)
    return {"s1": move, "s11": move * move / 2}


def fading_features(df: DataFrame, returns: str = "r", half_lives: Sequence[float] = (2, 5, 10, 20), lags: int = 30, depth: int = 2, steps: Sequence[str] = (), losses: bool = False) -> DataFrame:
    """Log signatures of the path of fading averages of the return, its size and its square (and of squared losses)."""
    base = windows.channels(F.col(returns))
    names = ["r", "abs_r", "r2", *(["neg_r2"] if losses else [])]
    rows = df.withColumns({f"_c_{n}": base[n] for n in names})
    states = recursion.ewma_by(rows, [f"_c_{n}" for n in names], half_lives)
    made = [f"ewma._c_{n}.hl={h:g}" for n in names for h in half_lives]
    short = {c: f"_s{i}" for i, c in enumerate(made)}
    out = features(states.withColumnsRenamed(short), list(short.values()), lags, depth, steps, log=True, prefix="fsig")
    return out.drop(*short.values(), *(f"_c_{n}" for n in names))


def parse_config(spec: str) -> tuple[str, int, int, list[str]]:
    """``name:lookback:level[:augmentations]``."""
    from ..functions.text import augmentations

    name, lookback, level, *rest = spec.split(":", 3)
    return name, int(lookback), int(level), augmentations(rest[0] if rest else "all")


def config_tables(df: DataFrame, specs: Sequence[str], target: str = "y") -> DataFrame:
    """For each configuration and term: rows, mean, and correlation with the target; the tables of all, one below another."""
    from .metrics import corr

    out = None
    for spec in specs:
        name, lookback, level, steps = parse_config(spec)
        made = features(df, ["r"], lookback, level, steps)
        cols = [c for c in made.columns if c.startswith("sig.term=")]
        long = made.select(target, F.explode(F.array(*(F.struct(F.lit(c).alias("term"), F.col(f"`{c}`").alias("x")) for c in cols))).alias("s")).select(target, "s.*")
        part = long.filter("x is not null").groupBy("term").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), corr(target, "x").alias("corr")).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
