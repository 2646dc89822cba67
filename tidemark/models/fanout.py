"""Fits and forecasts of many models over many series: a task's group is one (series, model, fold or seed)."""

from __future__ import annotations

import importlib
import json
import pickle
import time
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import check_columns
from . import boosting, gated, pgarch, recurrent, smoothing

#: A model: its kind, its columns, and the parameters of that kind.
Spec = dict[str, Any]
KINDS = ("es", "stes", "pgarch", "xgb_stes", "xgb_stes_alternating", "xgb_pgarch", "xgb_g_pgarch", "gated", "garch", "rnn", "gru", "rnn_stes", "custom")


def garch_fit(r: np.ndarray, steps: int = 300) -> tuple[float, float, float]:
    """omega, alpha, beta of a GARCH(1,1) by likelihood; persistence stays below one."""
    from ..operators.recursion import garch
    from .optim import lbfgs

    var = float(np.mean(r * r)) or 1e-8

    def unpack(t: np.ndarray) -> tuple[float, float, float]:
        p, s = 0.999 / (1 + np.exp(-np.clip(t[1], -30, 30))), 1 / (1 + np.exp(-np.clip(t[2], -30, 30)))
        return var * np.exp(np.clip(t[0], -20, 5)) * (1 - p), p * s, p * (1 - s)

    def value(t: np.ndarray) -> float:
        h = garch(r, *unpack(t), var)
        return float(np.mean(np.log(h) + r * r / h))

    def f(t: np.ndarray) -> tuple[float, np.ndarray]:
        step = 1e-5 * np.eye(3)
        return value(t), np.array([(value(t + e) - value(t - e)) / 2e-5 for e in step])

    return unpack(lbfgs(f, np.array([0.0, 3.0, -2.0]), steps)[0])


def smoother(spec: Spec, x: np.ndarray, y: np.ndarray, r: np.ndarray, seed: int = 0) -> smoothing.Smoother:
    """An unfitted smoother of a specification; with ``adaptive`` its penalties are weighed by a ridge pilot on these rows."""
    args = dict(spec.get("params", {}))
    adaptive = args.pop("adaptive", False)
    names = ["const", *(f"x{k}" for k in range(1, x.shape[1] if spec["kind"] == "stes" else 1))]
    if adaptive:
        args["weights"] = smoothing.adaptive_weights(x[:, : len(names)], y, r, names, seed=seed, restarts=args.get("restarts", 3))
    return smoothing.Smoother(names, seed=seed, **args)


@dataclass
class Fitted:
    """A forecaster that can be stored: ``(x, y, r) -> yhat`` over all rows that it is given."""

    kind: str
    model: Any
    columns: list[str]

    def __call__(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
        if self.kind in ("es", "stes"):
            return self.model.predict(x[:, : len(self.model.columns)], r)
        if self.kind == "garch":
            from ..operators.recursion import garch

            omega, alpha, beta, var = self.model
            return omega + alpha * r * r + beta * garch(r, omega, alpha, beta, var)
        if self.kind == "custom":
            return np.asarray(self.model.predict(x, y, r), float)
        if self.kind in ("pgarch", "xgb_pgarch", "xgb_g_pgarch"):
            return self.model.predict_variance(x[:, 1:], y)
        return self.model.predict(x if self.kind == "gated" else x[:, 1:], r)

    def gates(self, x: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The gate of each row, of the kinds that have one."""
        if self.kind in ("es", "stes"):
            return self.model.gates(x[:, : len(self.model.columns)])
        if self.kind in ("xgb_stes", "xgb_stes_alternating"):
            return self.model.gates(x[:, 1:])
        if self.kind in ("pgarch", "xgb_pgarch", "xgb_g_pgarch"):
            return pgarch.links(*self.model.scores(x[:, 1:]).T)[0][2]
        if self.kind in ("gated", "rnn_stes"):
            return np.asarray(self.model.gates(x if self.kind == "gated" else x[:, 1:], r), float).reshape(len(r), -1).mean(1)
        return np.full(len(r), np.nan)

    def loss(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> float:
        return float(np.mean((y - self(x, y, r)) ** 2))


def fit_one(spec: Spec, x: np.ndarray, y: np.ndarray, r: np.ndarray, seed: int = 0) -> Fitted:
    """A forecaster fitted on these rows. ``init``, a specification too, is fitted first, and boosted kinds start from it. Kind custom: ``factory``, a callable or the "module:name" of one, makes ``(x, y, r, seed, **params)`` a model with predict(x, y, r)."""
    kind, args, columns = spec["kind"], dict(spec.get("params", {})), list(spec.get("columns", []))
    own = x[:, 1:]
    first = fit_one(spec["init"] | {"columns": columns if spec["init"]["kind"] != "es" else []}, x, y, r, seed).model if spec.get("init") else None
    if kind in ("es", "stes"):
        model = smoother(spec, x, y, r, seed)
        model.fit(x[:, : len(model.columns)], y, r)
    elif kind == "garch":
        model = (*garch_fit(r), float(np.mean(r * r)))
    elif kind == "pgarch":
        model = pgarch.LinearPGarch(seed=seed, **args).fit(own, y)
    elif kind in ("xgb_pgarch", "xgb_g_pgarch"):
        model = (pgarch.g_only(**args) if kind == "xgb_g_pgarch" else pgarch.BoostedPGarch(**args)).fit(own, y, first)
    elif kind == "xgb_stes":
        model = boosting.BoostedSmoother(**args, init=None if first is None else boosting.WithConstant(first)).fit(own, y, r)
    elif kind == "xgb_stes_alternating":
        model = boosting.alternate(own, y, r, **args)
    elif kind == "gated":
        model = gated.GatedVariance(gated.GatedConfig(seed=seed, **args)).fit(x, y, r)
    elif kind in ("rnn", "gru", "rnn_stes"):
        shape = {"rnn": ("rnn", "variance"), "gru": ("gru", "variance"), "rnn_stes": (args.pop("cell", "rnn"), "gate")}[kind]
        model = recurrent.Recurrent(*shape, seed=seed, **args).fit(own, y, r)
    elif kind == "custom":
        factory = spec["factory"]
        if isinstance(factory, str):
            module, _, name = factory.partition(":")
            factory = getattr(importlib.import_module(module), name)
        model = factory(x, y, r, seed, **args)
    else:
        raise ValueError(f"unknown model kind {kind!r}; there are {KINDS}")
    return Fitted(kind, model, columns)


def packed(fitted: Fitted) -> bytes:
    """As it is stored."""
    return pickle.dumps(fitted)


def unpacked(blob: bytes, columns: Sequence[str]) -> Fitted:
    """What was stored, to be used with these columns, which must be those of the fit."""
    fitted = pickle.loads(blob)
    check_columns(fitted.columns, list(columns))
    return fitted


def fan(df: DataFrame, **choices: Sequence[Any]) -> DataFrame:
    """Each row once for every combination of the given literals, as further columns."""
    for name, values in choices.items():
        df = df.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Groups dealt over a fixed number of tasks: fits are slow and their rows few, so that merging small partitions would queue them up."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _xyz(rows: pd.DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.column_stack([np.ones(len(rows)), *(rows[c].to_numpy(float) for c in columns)]), rows["y"].to_numpy(float), rows["r"].to_numpy(float)


def forecasts(df: DataFrame, specs: dict[str, Spec], train_to: int | None = None, seeds: Sequence[int] = (0,), by: Sequence[str] = ("entity_id",), time_col: str = "ts_utc") -> DataFrame:
    """Forecasts of every (series, model, seed) on all rows after a fit on the first ``train_to`` (all by default).

    The recursion runs once over all rows, so that rows behind the training begin from its last state. Returns by,
    model, seed, time, step, y, yhat, seconds.
    """
    columns = sorted({c for s in specs.values() for c in s.get("columns", [])})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "model string, seed long", f"{time_col} {kinds[time_col]}", "step long, y double, yhat double, seconds double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time_col, ignore_index=True)
        spec, began = specs[group["model"].iloc[0]], time.perf_counter()
        x, y, r = _xyz(group, spec.get("columns", []))
        known = ~np.isnan(y)
        cut = int(known.sum()) if train_to is None else min(train_to, int(known.sum()))
        model = fit_one(spec, x[:cut], y[:cut], r[:cut], int(group["seed"].iloc[0]))
        yhat = model(x, np.where(known, y, 0.0), r)
        return group[[*by, "model", "seed", time_col]].assign(step=np.arange(len(group)), y=y, yhat=yhat, seconds=time.perf_counter() - began)

    rows = fan(df.select(*dict.fromkeys([*by, time_col, *columns, "y", "r"])), model=list(specs), seed=[int(s) for s in seeds]).withColumn("seed", F.col("seed").cast("long"))
    out = spread(rows, *by, "model", "seed").groupBy(*by, "model", "seed").applyInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("y", "yhat")})


def fit(df: DataFrame, specs: dict[str, Spec], by: Sequence[str] = ("entity_id",), time_col: str = "ts_utc", only: DataFrame | None = None) -> DataFrame:
    """(by, model, artifact, loss, n, seconds): every (series, model) fitted on its rows with a target, as it is stored.

    ``only(by, model)`` names the series and models to fit, of which others' rows are not sent.
    """
    columns = sorted({c for s in specs.values() for c in s.get("columns", [])})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "model string, artifact binary, loss double, n long, seconds double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time_col, ignore_index=True)
        spec, began = specs[group["model"].iloc[0]], time.perf_counter()
        x, y, r = _xyz(group, spec.get("columns", []))
        fitted = fit_one(spec, x, y, r)
        return group[[*by, "model"]].head(1).assign(artifact=[packed(fitted)], loss=fitted.loss(x, y, r), n=len(y), seconds=time.perf_counter() - began)

    rows = fan(df.select(*dict.fromkeys([*by, time_col, *columns, "y", "r"])).filter("y is not null"), model=list(specs))
    rows = rows if only is None else rows.join(only.select(*by, "model"), [*by, "model"], "left_semi")
    return spread(rows, *by, "model").groupBy(*by, "model").applyInPandas(run, schema)


def apply(df: DataFrame, artifacts: DataFrame, specs: dict[str, Spec], by: Sequence[str] = ("entity_id",), time_col: str = "ts_utc") -> DataFrame:
    """Forecasts (by, model, time, step, y, yhat, gate) on all rows by stored ``artifacts(by, model, artifact)``; nothing is fitted.

    A series' rows meet its artifacts, one a model. Columns other than those of the fit, or in another order, are an error.
    """
    columns = sorted({c for s in specs.values() for c in s.get("columns", [])})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "model string", f"{time_col} {kinds[time_col]}", "step long, y double, yhat double, gate double"])

    def run(group: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        group, out = group.sort_values(time_col, ignore_index=True), []
        for name, blob in zip(stored["model"], stored["artifact"], strict=True) if len(group) else ():
            fitted = unpacked(blob, specs[name].get("columns", []))
            x, y, r = _xyz(group, fitted.columns)
            yhat = fitted(x, np.where(np.isnan(y), 0.0, y), r)
            out.append(group[[*by, time_col]].assign(model=name, step=np.arange(len(group)), y=y, yhat=yhat, gate=fitted.gates(x, r))[[*by, "model", time_col, "step", "y", "yhat", "gate"]])
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in (*by, "model", time_col, "step", "y", "yhat", "gate")}).astype({"step": "int64", "y": float, "yhat": float, "gate": float})

    rows = df.select(*dict.fromkeys([*by, time_col, *columns, "y", "r"]))
    made = rows.groupBy(*by).cogroup(artifacts.select(*by, "model", "artifact").groupBy(*by)).applyInPandas(run, schema)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("y", "yhat", "gate")})


def fold_value(spec: Spec, group: pd.DataFrame, loss: str = "mse") -> tuple[float, float, int]:
    """(loss on the rows from train_to on of a fit on those before it, epochs that it took, scored rows) of one fold's rows."""
    group = group.sort_values("step", ignore_index=True)
    at = int((group["step"] < group["train_to"]).sum())
    x, y, r = _xyz(group, spec.get("columns", []))
    if spec["kind"] in ("es", "stes"):
        return smoothing.fold_score(x, y, r, at, len(y), smoother(spec, x[:at], y[:at], r[:at])), np.nan, len(y) - at
    if spec["kind"] == "gated":
        model = fit_one(spec, x[:at], y[:at], r[:at]).model
        return smoothing.score(y[at:], model.predict(x[at:], r[at:], float(np.mean(r[max(0, at - 20) : at] ** 2))), loss), model.epochs, len(y) - at
    return smoothing.score(y[at:], fit_one(spec, x[:at], y[:at], r[:at])(x, y, r)[at:], loss), np.nan, len(y) - at


def fold_scores(df: DataFrame, specs: dict[str, Spec], loss: str = "mse", by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """(by, model, fold, score, n, rounds): the loss on each validation block of a fit on the rows before it, and how many epochs it took.

    ``df`` has each row once for each fold that it is in, with fold, train_to and val_to (``folds.block_rows``).
    """
    columns = sorted({c for s in specs.values() for c in s.get("columns", [])})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "model string, fold long, score double, n long, rounds double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        value, rounds, n = fold_value(specs[group["model"].iloc[0]], group, loss)
        return group[[*by, "model", "fold"]].head(1).assign(score=value, n=n, rounds=rounds)

    rows = fan(df.select(*dict.fromkeys([*by, "step", *columns, "y", "r", "fold", "train_to"])), model=list(specs)).filter("train_to > 1")
    return spread(rows, *by, "model", "fold").groupBy(*by, "model", "fold").applyInPandas(run, schema)


def best(scores: DataFrame, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """The model of the lowest mean score over folds, ties by name, and its mean number of epochs (null for others than gated ones)."""
    mean = scores.groupBy(*by, "model").agg(F.avg("score").alias("score"), F.round(F.avg(F.when(~F.isnan("rounds"), F.col("rounds")))).cast("int").alias("rounds"))
    return mean.groupBy(*by).agg(F.min(F.struct("score", "model", "rounds")).alias("b")).select(*by, "b.model", "b.score", "b.rounds")


def search(df: DataFrame, base: Spec, space: dict[str, Sequence[Any]], n: int, splits: int = 3, seed: int = 0, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """(by, model, score, rounds, params_json): the best of ``n`` drawn parameter sets over each series' own expanding folds."""
    from ..operators.folds import block_rows

    specs = random_specs(base, space, n, seed)
    found = best(fold_scores(block_rows(df, splits, list(by)), specs, by=by), by)
    params = F.create_map(*(F.lit(v) for name, spec in specs.items() for v in (name, json.dumps(spec.get("params", {}), sort_keys=True))))
    return found.withColumn("params_json", params[F.col("model")])


def study(df: DataFrame, specs: dict[str, Spec], seeds: Sequence[int], train_to: int, by: Sequence[str] = ("entity_id",), time_col: str = "ts_utc") -> DataFrame:
    """(by, model, seed, is_rmse, oos_rmse, coefficients): each smoother fitted from each seed's start, with its coefficients by name."""
    columns = sorted({c for s in specs.values() for c in s.get("columns", [])})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "model string, seed long, is_rmse double, oos_rmse double, coefficients map<string,double>"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time_col, ignore_index=True)
        name, seed = group["model"].iloc[0], int(group["seed"].iloc[0])
        x, y, r = _xyz(group, specs[name].get("columns", []))
        fitted = fit_one(specs[name], x[:train_to], y[:train_to], r[:train_to], seed)
        gap = (y - fitted(x, y, r)) ** 2
        rmse = lambda a: float(np.sqrt(a.mean())) if len(a) else np.nan
        names = ["const", *specs[name].get("columns", [])]
        return group[[*by]].head(1).assign(model=name, seed=seed, is_rmse=rmse(gap[:train_to]), oos_rmse=rmse(gap[train_to:]), coefficients=[dict(zip(names, map(float, fitted.model.beta), strict=False))])

    rows = fan(df.select(*dict.fromkeys([*by, time_col, *columns, "y", "r"])).filter("y is not null"), model=list(specs), seed=[int(s) for s in seeds]).withColumn("seed", F.col("seed").cast("long"))
    return spread(rows, *by, "model", "seed").groupBy(*by, "model", "seed").applyInPandas(run, schema)


def best_seed(made: DataFrame, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Of each (series, model) the seed of the lowest error out of sample, ties by seed."""
    rest = F.struct("oos_rmse", "seed", "is_rmse", F.map_entries("coefficients").alias("c"))
    return made.groupBy(*by, "model").agg(F.min(rest).alias("b")).select(*by, "model", "b.seed", "b.is_rmse", "b.oos_rmse", F.map_from_entries("b.c").alias("coefficients"))


def wide_coefficients(chosen: DataFrame, models: Sequence[str], by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """A row a (series, coefficient), a column a model."""
    return chosen.select(*by, "model", F.explode("coefficients").alias("coefficient", "value")).groupBy(*by, "coefficient").pivot("model", list(models)).agg(F.first("value"))


def smoother_params(df: DataFrame, spec: Spec, by: Sequence[str] = ("entity_id",), time_col: str = "ts_utc") -> DataFrame:
    """(by, params_json, loss) of a smoother fitted to each series."""
    columns = list(spec.get("columns", []))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "params_json string, loss double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time_col, ignore_index=True)
        x, y, r = _xyz(group, columns)
        model = smoothing.Smoother(["const", *columns], **spec.get("params", {})).fit(x, y, r)
        return group[[*by]].head(1).assign(params_json=json.dumps(model.params(), sort_keys=True), loss=float(model.train_loss))

    return df.select(*dict.fromkeys([*by, time_col, *columns, "y", "r"])).dropna("any").transform(spread, *by).groupBy(*by).applyInPandas(run, schema)


def importances(df: DataFrame, spec: Spec, by: Sequence[str] = ("entity_id",), time_col: str = "ts_utc") -> DataFrame:
    """(by, feature, importance): of a boosted model fitted to each series, how often its trees split each column."""
    columns = list(spec.get("columns", []))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "feature string, importance double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time_col, ignore_index=True)
        x, y, r = _xyz(group, columns)
        model = fit_one(spec, x, y, r).model
        boosters = model.boosters.values() if hasattr(model, "boosters") else [model.model]
        total = sum((b.importance(len(columns)) for b in boosters), np.zeros(len(columns)))
        return pd.DataFrame({c: [group[c].iloc[0]] * len(columns) for c in by} | {"feature": columns, "importance": total})

    rows = df.select(*dict.fromkeys([*by, time_col, *columns, "y", "r"])).filter("y is not null")
    return spread(rows, *by).groupBy(*by).applyInPandas(run, schema).orderBy(*by, F.col("importance").desc(), "feature")


def random_specs(base: Spec, space: dict[str, Sequence[Any]], n: int, seed: int = 0) -> dict[str, Spec]:
    """n drawn parameter sets of a model, named by their number."""
    g = np.random.default_rng(seed)
    return {f"c{k:03d}": base | {"params": base.get("params", {}) | {p: v[int(g.integers(len(v)))] for p, v in space.items()}} for k in range(n)}
