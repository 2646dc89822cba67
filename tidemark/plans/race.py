"""The daily forecast race, its backfill, and benchmarks: set-based over all tickers and models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import next_trading_day
from ..models import fanout
from ..operators import metrics, panel, stats, windows
from ..operators.store import Store, policy_for, refit_due
from ..sources.shared import checkpoint


def load_config(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}


def registry(config: dict, only: Sequence[str] | None = None) -> dict[str, fanout.Spec]:
    """Models of a configuration; one of an unknown kind is an error, not a warning."""
    out = {}
    for name, m in config.get("models", {}).items():
        if m.get("enabled", True) and (not only or name in only):
            spec = {k: v for k, v in m.items() if k in ("kind", "columns", "params", "factory", "init")}
            if spec.get("kind") not in fanout.KINDS:
                raise ValueError(f"model {name}: unknown kind {spec.get('kind')!r}")
            out[name] = spec
    return out


def observations(bars: DataFrame, as_of: str, scale: float = 100.0) -> DataFrame:
    """Rows up to ``as_of`` with returns, features, the target date and the target; the newest row has no target yet."""
    w = windows.by_entity()
    rows = panel.time_range(bars, None, as_of)
    r = (windows.log_return() * scale).alias("r")
    rows = rows.select("entity_id", "ts_utc", r).dropna(subset=["r"])
    rows = rows.withColumns({"abs_r": F.abs("r"), "sq_r": F.col("r") * F.col("r"), "y": F.pow(F.lead("r").over(w), 2), "target": F.lead("ts_utc").over(w)})
    return rows.withColumn("target", F.coalesce(F.to_date("target"), next_trading_day(F.to_date("ts_utc"))))


def refits(spark: SparkSession, store: Store, config: dict, names: Sequence[str], as_of: str, force: bool) -> dict[str, tuple[bool, str | None]]:
    """Of each model whether it is due, and its newest version."""
    models, due = store.read("models"), {}
    for name in names:
        row = refit_due(models, spark.createDataFrame([(name,)], "model_type string"), F.lit(as_of).cast("date"), **policy_for(config, name, force)).first()
        due[name] = (row["refit"], row["model_id"])
    return due


def run(spark: SparkSession, bars: DataFrame, store: Store, config: dict, as_of: str, force: bool = False, only: Sequence[str] | None = None) -> DataFrame:
    """Record actuals, refit the models that are due, forecast the next session of every ticker, and score.

    Actuals and forecasts have the date of the target session as their key. Training uses rows with a known target; the
    forecast is made from the newest row. A model that is not due is loaded as it was fitted; only a series that it has never seen is
    fitted, and added to it.
    """
    specs = registry(config, only)
    training = config.get("training", {})
    rows = checkpoint(observations(bars, as_of))
    sizes = rows.groupBy("entity_id").count().filter(F.col("count") >= training.get("min_history_days", 500)).select("entity_id")
    rows = rows.join(sizes, "entity_id", "left_semi")
    known = rows.filter("y is not null")
    newest_actuals = known if not store._exists("actuals") else known.join(store.read("actuals").select(F.col("ticker").alias("entity_id"), F.to_date("target_utc").alias("target")), ["entity_id", "target"], "left_anti")
    store.upsert_actuals(newest_actuals.select(F.col("entity_id").alias("ticker"), F.to_timestamp("target").alias("target_utc"), F.lit(1).alias("horizon"), "y"))
    due = refits(spark, store, config, list(specs), as_of, force)
    end = str(known.agg(F.max("ts_utc")).first()[0])
    ids = {name: model_id for name, (refit, model_id) in due.items() if not refit}
    fresh = {n: specs[n] for n in specs if n not in ids}
    if fresh:
        fitted = checkpoint(fanout.fit(known, fresh))
        losses = {r["model"]: r["loss"] for r in fitted.groupBy("model").agg(F.avg("loss").alias("loss")).collect()}
        for name in fresh:
            own = fitted.filter(F.col("model") == name)
            ids[name] = store.register(name, specs[name], None, end, ("train_mse", losses.get(name, float("nan"))), tuple(specs[name].get("columns", ())), as_of, own)
    model_of = F.create_map(*(F.lit(x) for pair in ((i, n) for n, i in ids.items()) for x in pair))
    stored = store.artifacts(*ids.values()).withColumn("model", model_of[F.col("model_id")])
    loaded = {n: specs[n] for n in specs if n not in fresh}
    if loaded:
        unseen = fanout.fan(sizes, model=list(loaded)).join(stored.select("entity_id", "model"), ["entity_id", "model"], "left_anti")
        late = checkpoint(fanout.fit(known, loaded, only=unseen))
        if not late.isEmpty():
            for name in loaded:
                store.add_artifacts(late.filter(F.col("model") == name).withColumn("model_id", F.lit(ids[name])))
            stored = store.artifacts(*ids.values()).withColumn("model", model_of[F.col("model_id")])
    made = fanout.apply(rows, stored, specs)
    last = rows.groupBy("entity_id").agg(F.max("ts_utc").alias("ts_utc"), F.max_by("target", "ts_utc").alias("target"))
    newest = checkpoint(made.join(last, ["entity_id", "ts_utc"]))
    model_id = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    store.upsert_forecasts(
        newest.select(model_id[F.col("model")].alias("model_id"), F.col("entity_id").alias("ticker"), F.lit(as_of).cast("timestamp").alias("asof_utc"), F.to_timestamp("target").alias("target_utc"), F.lit(1).alias("horizon"), "yhat")
    )
    return newest.select("entity_id", "model", F.to_date("target").alias("target"), "yhat")


def backfill_by_day(spark: SparkSession, bars: DataFrame, store: Store, config: dict, start: str, end: str, **kwargs: Any) -> None:
    """The race of each business day, one after the other, as it would have been run. ``backfill`` writes the same rows in one job."""
    for day in pd.bdate_range(start, end):
        run(spark, bars, store, config, f"{day.date()} 00:00:00", **kwargs)


@dataclass
class Period:
    """The days on which one version of a model forecasts; ``fresh`` if it is fitted on the first of these rather than loaded."""

    model: str
    model_id: str
    version: int
    first: date
    last: date
    trained_end: Any
    fresh: bool


def schedule(store: Store, names: Sequence[str], config: dict, ends: Sequence[tuple[date, Any]], force: bool = False) -> list[Period]:
    """The versions that the refit policies make of ``ends``, the days in order with the newest row that is known with its outcome on each."""
    out: list[Period] = []
    for name in names:
        policy = policy_for(config, name, force)
        model_id = store.latest_model_id(name)
        known = store.model(model_id) if model_id else None
        trained, now = known["trained_end"] if known else None, None
        for day, end in ends:
            if policy.get("force") or policy["policy"] == "expanding_window":
                due = True
            elif policy["policy"] == "always_load":
                due = model_id is None
            elif policy["policy"] == "every_n_days":
                due = model_id is None or trained is None or (day - trained.date()).days >= policy.get("n_days", 30)
            else:
                raise ValueError(f"unknown refit policy {policy['policy']!r}")
            if due:
                model_id, version = store.reserve(name)
                trained, now = end, Period(name, model_id, version, day, day, end, True)
                out.append(now)
            elif now is None:
                now = Period(name, model_id, known["version"], day, day, trained, False)
                out.append(now)
            now.last = day
    return out


def backfill(spark: SparkSession, bars: DataFrame, store: Store, config: dict, start: str, end: str, force: bool = False, only: Sequence[str] | None = None, lanes: int = 1) -> list[Period]:
    """What ``backfill_by_day`` writes, by one job and one commit a table: fits, forecasts and outcomes of all business days from ``start`` to ``end``.

    Each row knows the days on which it is its series' newest. When refits are due follows from the newest known row of each day, of which the driver sees
    one date a day; versions are taken in that order. A (series, model) is a group that has its rows once: it fits each version on
    the rows known on its first day (a series that comes later, on its own first day), runs the recursion once over the
    version's days, and returns forecasts and artifacts as rows. With ``lanes`` a series' versions are dealt to so many groups, each
    with the rows: for few long series. Built-in models' forecasts hang on no later row; a custom model is asked for each day with the rows up to it.
    Days on which no series has enough history are left out. Returns the versions and their days.
    """
    specs, least = registry(config, only), config.get("training", {}).get("min_history_days", 500)
    w, close = windows.by_entity(), pd.bdate_range(start, end)
    if not len(close):
        return []
    low, high = F.lit(close[0].date()), F.lit(close[-1].date())
    rows = observations(bars, f"{close[-1].date()} 00:00:00").withColumns({"step": F.row_number().over(w) - 1, "next_ts": F.lead("ts_utc").over(w), "known_ts": F.lag("ts_utc").over(w)})
    since, until = F.greatest(F.to_date("ts_utc"), low), F.least(F.coalesce(F.to_date("next_ts"), high), high)
    newest = lambda d: (F.weekday(d) < 5) & (F.col("ts_utc") <= d.cast("timestamp")) & (F.col("next_ts").isNull() | (F.col("next_ts") > d.cast("timestamp")))
    days = F.when((F.col("step") + 1 >= least) & (since <= until), F.filter(F.sequence(since, until), newest))
    rows = checkpoint(rows.withColumn("days", days))
    ends = rows.select(F.explode("days").alias("day"), "known_ts").groupBy("day").agg(F.max("known_ts").alias("end")).filter("end is not null").orderBy("day").collect()
    if not ends:
        return []
    periods = schedule(store, list(specs), config, [(r["day"], r["end"]) for r in ends], force)
    columns = sorted({c for s in specs.values() for c in s.get("columns", [])})
    loaded = [p.model_id for p in periods if not p.fresh]
    model_of = {p.model_id: p.model for p in periods}

    def one(group: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(group):
            group = group.sort_values("step", ignore_index=True)
            entity, name, lane = (group[c].iloc[0] for c in ("entity_id", "model", "lane"))
            x = np.column_stack([np.ones(len(group)), *(group[c].to_numpy(float) for c in specs[name].get("columns", []))])
            y, r = group["y"].to_numpy(float), group["r"].to_numpy(float)
            blobs = dict(zip(stored["model_id"], stored["artifact"], strict=True))
            asked = [(i, d) for i, ds in enumerate(group["days"]) if ds is not None for d in ds]
            for k, p in enumerate(p for p in periods if p.model == name):
                own = [(i, d) for i, d in asked if p.first <= d <= p.last] if k % lanes == lane else []
                if not own:
                    continue
                if p.model_id in blobs:
                    fitted = fanout.unpacked(blobs[p.model_id], specs[name].get("columns", []))
                else:
                    at = own[0][0]  # rows before the newest one have their outcome
                    fitted = fanout.fit_one(specs[name], x[:at], y[:at], r[:at])
                    out.append((entity, p.model_id, None, None, None, fanout.packed(fitted), fitted.loss(x[:at], y[:at], r[:at]), at, p.fresh and own[0][1] == p.first))
                if fitted.kind == "custom":
                    path = {i: fitted(x[: i + 1], np.append(y[:i], 0.0), r[: i + 1])[-1] for i, _ in own}
                else:
                    upto = own[-1][0] + 1
                    path = fitted(x[:upto], np.append(y[: upto - 1], 0.0), r[:upto])
                out += [(entity, p.model_id, d, group["ts_utc"].iloc[i], float(path[i]), None, None, None, None) for i, d in own]
        return pd.DataFrame(out, columns=["entity_id", "model_id", "day", "ts_utc", "yhat", "artifact", "loss", "n", "first"]).astype({"n": "Int64", "first": "boolean"})

    kind = dict(rows.dtypes)["ts_utc"]
    fan = fanout.fan(rows.select(*dict.fromkeys(["entity_id", "ts_utc", "step", "days", *columns, "y", "r"])), model=list(specs), lane=list(range(lanes)))
    model_column = F.create_map(*(F.lit(v) for pair in model_of.items() for v in pair))[F.col("model_id")]
    blobs = fanout.fan(store.artifacts(*loaded).select("entity_id", "model_id", "artifact", model_column.alias("model")), lane=list(range(lanes)))
    group = ["entity_id", "model", "lane"]
    made = fanout.spread(fan, *group).groupBy(*group).cogroup(blobs.groupBy(*group)).applyInPandas(one, f"entity_id string, model_id string, day date, ts_utc {kind}, yhat double, artifact binary, loss double, n long, first boolean")
    made = checkpoint(made)
    fits = made.filter("artifact is not null")
    losses = {r["model_id"]: r["loss"] for r in fits.filter("first").groupBy("model_id").agg(F.avg("loss").alias("loss")).collect()}
    store.add_artifacts(fits)
    fresh = [p for p in periods if p.fresh]
    if fresh:
        store.add_models([{"model_id": p.model_id, "model_type": p.model, "version": p.version, "params": specs[p.model], "trained": (None, p.trained_end), "metric": ("train_mse", losses.get(p.model_id, float("nan"))), "columns": tuple(specs[p.model].get("columns", ())), "created": f"{p.first} 00:00:00", "stored": True} for p in fresh])
    target = next_trading_day(F.to_date("ts_utc"))
    store.upsert_forecasts(made.filter("day is not null").select("model_id", F.col("entity_id").alias("ticker"), F.to_timestamp("day").alias("asof_utc"), F.to_timestamp(target).alias("target_utc"), F.lit(1).alias("horizon"), "yhat"))
    entities = rows.filter("days is not null").select("entity_id").distinct()
    known = rows.filter("y is not null").join(entities, "entity_id", "left_semi").select("entity_id", "target", "y")
    if store._exists("actuals"):
        known = known.join(store.read("actuals").select(F.col("ticker").alias("entity_id"), F.to_date("target_utc").alias("target")), ["entity_id", "target"], "left_anti")
    store.upsert_actuals(known.select(F.col("entity_id").alias("ticker"), F.to_timestamp("target").alias("target_utc"), F.lit(1).alias("horizon"), "y"))
    return periods


def walk_forward(df: DataFrame, specs: dict[str, fanout.Spec], every: int = 21, first: int = 500, window: int | None = None) -> DataFrame:
    """The whole backfill in one job: a model refitted every ``every`` rows forecasts the rows up to its next fit.

    Each (series, model, block) is a group of the rows up to its end, or of the last ``window`` before it.
    """
    columns = sorted({c for s in specs.values() for c in s.get("columns", [])})

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("step", ignore_index=True)
        block, name = int(group["block"].iloc[0]), group["model"].iloc[0]
        at = int((group["step"] < first + block * every).sum())
        x = np.column_stack([np.ones(len(group)), *(group[c].to_numpy(float) for c in specs[name].get("columns", []))])
        y, r = group["y"].to_numpy(float), group["r"].to_numpy(float)
        yhat = fanout.fit_one(specs[name], x[:at], y[:at], r[:at])(x, y, r)
        return group.assign(yhat=yhat)[["entity_id", "model", "block", "ts_utc", "step", "y", "yhat"]].iloc[at:]

    # a row is in every block that trains on it or is forecast in it
    lowest = F.greatest(F.floor((F.col("step") - first) / every), F.lit(0)).cast("long")
    most = F.floor((F.max("step").over(Window.partitionBy("entity_id")) - first) / every).cast("long")
    last = most if window is None else F.least(most, F.floor((F.col("step") + window - first) / every).cast("long"))
    rows = df.select(*dict.fromkeys(["entity_id", "ts_utc", "step", *columns, "y", "r"])).withColumns({"lo": lowest, "hi": last}).filter("hi >= lo")
    rows = fanout.fan(rows.withColumn("block", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi"), model=list(specs))
    kind = dict(df.dtypes)["ts_utc"]
    return fanout.spread(rows, "entity_id", "model", "block").groupBy("entity_id", "model", "block").applyInPandas(one, f"entity_id string, model string, block long, ts_utc {kind}, step long, y double, yhat double")


def benchmark(forecasts: DataFrame, baseline: str, oos_from: int, scope: str = "oos", extra: dict[str, Column | metrics.Function] | None = None) -> dict[str, DataFrame]:
    """Metrics in and out of sample, tests of equal accuracy against a baseline (out of sample, or ``full``) and calibration of long (entity, model, step, y, yhat) rows.

    ``extra`` are metrics of the user's own beside the built-in ones: aggregate columns, functions of the arrays y and yhat, or ``metrics.Mergeable``.
    """
    oos = forecasts.filter(F.col("step") >= oos_from)
    tested = oos if scope == "oos" else forecasts
    key = ["entity_id", "ts_utc"]
    gap = (F.col("y") - F.col("yhat")) * (F.col("y") - F.col("yhat"))
    base = tested.filter(F.col("model") == baseline).select(*key, gap.alias("loss_b"))
    others = tested.filter(F.col("model") != baseline).select(*key, "model", gap.alias("loss_a"))
    table = metrics.by_model(oos, ["entity_id", "model"])
    columns = {n: c for n, c in (extra or {}).items() if isinstance(c, Column)}
    functions = {n: f for n, f in (extra or {}).items() if n not in columns}
    if columns:
        table = table.join(oos.groupBy("entity_id", "model").agg(*(c.alias(n) for n, c in columns.items())), ["entity_id", "model"])
    if functions:
        table = table.join(metrics.by_functions(oos, ["entity_id", "model"], functions), ["entity_id", "model"])
    return {
        "metrics": table,
        "metrics_is": metrics.by_model(forecasts.filter(F.col("step") < oos_from), ["entity_id", "model"]),
        "dm": stats.with_p_value(stats.diebold_mariano(others.join(base, key), ["entity_id", "model"])),
        "mz": stats.mincer_zarnowitz(oos, ["entity_id", "model"]),
    }


def compare(old: DataFrame, new: DataFrame, metric: Callable[[], Column] = metrics.rmse) -> DataFrame:
    """Old and new score of (y, yhat) rows, the improvement, and whether the new model takes over."""
    both = old.select("y", "yhat", F.lit("old").alias("v")).unionByName(new.select("y", "yhat", F.lit("new").alias("v")))
    wide = both.groupBy().pivot("v", ["old", "new"]).agg(metric())
    return wide.withColumn("improvement", F.col("old") - F.col("new")).withColumn("promote", F.col("improvement") > 0)
