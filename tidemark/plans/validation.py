"""Candidates against baselines: rolling refits, gains, ranks and tests by window, and the manifest of what was tried."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import fanout
from ..operators import diagnostics, folds, metrics, stats
from ..operators.windows import by_entity


def rolling_forecasts(df: DataFrame, specs: dict[str, fanout.Spec], train: int, test: int, step: int, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """(by, window_no, model, ts_utc, step, y, yhat, seconds) of the test rows of each rolling window, each model refitted on the window's training rows.

    Every (series, window, model) is a group of ``train + test`` rows; windows begin every ``step`` rows of a series, as many as fit.
    """
    columns = sorted({c for s in specs.values() for c in s.get("columns", [])})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"window_no long, model string, ts_utc {kinds['ts_utc']}, step long, y double, yhat double, seconds double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, began = group.sort_values("step", ignore_index=True), time.perf_counter()
        spec = specs[group["model"].iloc[0]]
        x, y, r = fanout._xyz(group, spec.get("columns", []))
        yhat = fanout.fit_one(spec, x[:train], y[:train], r[:train])(x, y, r)
        out = group[[*by, "window_no", "model", "ts_utc", "step", "y"]].assign(yhat=yhat, seconds=time.perf_counter() - began)
        return out.iloc[train:]

    rows = folds.rolling_rows(df.select(*dict.fromkeys([*by, "ts_utc", "step", *columns, "y", "r"])), train + test, step, list(by))
    rows = fanout.fan(rows, model=list(specs))
    return fanout.spread(rows, *by, "window_no", "model").groupBy(*by, "window_no", "model").applyInPandas(run, schema)


def candidate_rows(forecasts: DataFrame, candidate: str, baselines: Sequence[str], by: Sequence[str], when: str = "ts_utc", p_values: bool = True) -> DataFrame:
    """A row for each of ``by``: the candidate's qlike, rmse and rank, and its gain and equal-accuracy test against each baseline.

    Forecasts are brought side by side by one aggregation; of models with the same qlike the candidate ranks first.
    """
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("yhat")))
    wide = forecasts.filter(F.col("model").isin([candidate, *baselines])).groupBy(*by, when).agg(F.max("y").alias("y"), of(candidate).alias("_c"), *(of(b).alias(f"_{b}") for b in baselines))
    scores = wide.groupBy(*by).agg(F.count("*").alias("n"), metrics.qlike("y", "_c").alias("qlike"), metrics.rmse("y", "_c").alias("rmse"), *(metrics.qlike("y", f"_{b}").alias(f"qlike_{b}") for b in baselines))
    ahead = sum(((F.col(f"qlike_{b}") < F.col("qlike")).cast("int") for b in baselines), F.lit(1))
    scores = scores.withColumns({"rank": ahead, **{f"gain_vs_{b}": F.col(f"qlike_{b}") - F.col("qlike") for b in baselines}})
    gap = lambda c: (F.col("y") - F.col(c)) * (F.col("y") - F.col(c))
    pairs = F.explode(F.array(*(F.struct(F.lit(b).alias("baseline"), gap(f"_{b}").alias("loss_b")) for b in baselines))).alias("p")
    tests = stats.diebold_mariano(wide.select(*by, when, gap("_c").alias("loss_a"), pairs).select(*by, when, "loss_a", "p.*"), [*by, "baseline"], time=when)
    tests = stats.with_p_value(tests) if p_values else tests
    each = [(f"{short}_vs_{b}", name, b) for b in baselines for short, name in (("dm", "dm"), *((("p", "p"),) if p_values else ()))]
    tests = tests.groupBy(*by).agg(*(F.max(F.when(F.col("baseline") == b, F.col(name))).alias(alias) for alias, name, b in each))
    return scores.join(tests, list(by))


@dataclass(frozen=True)
class Candidate:
    """One model to be tried, of a family, with the specification that fits it."""

    name: str
    family: str
    spec: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.spec.get("kind") not in fanout.KINDS:
            raise ValueError(f"candidate {self.name}: unknown kind {self.spec.get('kind')!r}")


def families(columns: Sequence[str]) -> list[Candidate]:
    """Searches over these columns: unequal screening of the channels, boosting that favours the gate, and structured recurrent gates."""
    cols = list(columns)
    out = [Candidate(f"screen_{c}", "screening", {"kind": "pgarch", "columns": cols, "params": {"dynamic": d}}) for c, d in (("phi", ("phi",)), ("g", ("g",)), ("phi_g", ("phi", "g")))]
    out += [Candidate(f"boost_{n}", "boosting", {"kind": "xgb_pgarch", "columns": cols, "params": {"order": o, "rounds": 4}}) for n, o in (("g", ("g",)), ("g_first", ("g", "phi")), ("g_twice", ("g", "phi", "g")))]
    out += [Candidate(f"gated_{c}", "recurrent", {"kind": "gated", "columns": cols, "params": {"gate": "gru_linear", "candidate": c, "epochs": 15}}) for c in ("r2", "linear_pos", "mlp_pos")]
    return out


def chosen(candidates: Iterable[Candidate], names: Sequence[str] | None = None, family: str | None = None) -> list[Candidate]:
    """Those of the given names and family; a name that is not there is an error."""
    every = list(candidates)
    if missing := sorted(set(names or ()) - {c.name for c in every}):
        raise ValueError(f"no candidates {missing}; there are {sorted(c.name for c in every)}")
    return [c for c in every if (not names or c.name in names) and (family is None or c.family == family)]


def manifest(candidates: Iterable[Candidate]) -> str:
    """The candidates as JSON, sorted by name, with a key for each."""
    return json.dumps({c.name: asdict(c) for c in sorted(candidates, key=lambda c: c.name)}, sort_keys=True, default=list)


def try_candidates(df: DataFrame, candidates: Sequence[Candidate], baselines: dict[str, fanout.Spec], train: int, test: int, step: int, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """A row for each (series, candidate): its figures over all test rows of the rolling windows, its family, its time and its specification."""
    specs = {c.name: c.spec for c in candidates} | baselines
    made = rolling_forecasts(df, specs, train, test, step, by)
    seconds = made.filter(F.col("model").isin([c.name for c in candidates])).select(*by, "window_no", "model", "seconds").distinct().groupBy(*by, F.col("model").alias("candidate")).agg(F.sum("seconds").alias("runtime_seconds"))
    base = made.filter(F.col("model").isin(list(baselines)))
    mine = made.filter(~F.col("model").isin(list(baselines))).withColumn("candidate", F.col("model")).withColumn("model", F.lit("candidate"))
    both = mine.unionByName(base.withColumn("candidate", F.explode(F.array(*(F.lit(c.name) for c in candidates)))))
    about = df.sparkSession.createDataFrame([(c.name, c.family, json.dumps(c.spec, sort_keys=True, default=list)) for c in candidates], "candidate string, family string, params_json string")
    return candidate_rows(both, "candidate", list(baselines), [*by, "candidate"]).join(seconds, [*by, "candidate"]).join(about, "candidate")


def comparison(forecasts: DataFrame, a: str, b: str, lags: int = 3, window: int = 5, entity: str = "entity_id") -> dict[str, DataFrame]:
    """Two models over their seeds' means: rows with the loss difference, its lags and the innovation; the events' table and their mean path.

    ``forecasts(entity_id, ts_utc, model, r, y, yhat)``, a row a seed.
    """
    of = lambda m: F.avg(F.when(F.col("model") == m, F.col("yhat"))).alias(m)
    rows = forecasts.groupBy(entity, "ts_utc").agg(F.max("r").alias("r"), F.max("y").alias("y"), of(a), of(b))
    gap = lambda c: (F.col("y") - F.col(c)) * (F.col("y") - F.col(c))
    w = by_entity(entity)
    rows = rows.withColumns({"loss_a": gap(a), "loss_b": gap(b)}).withColumn("d", F.col("loss_a") - F.col("loss_b"))
    rows = rows.withColumns({f"d_lag{k}": F.lag("d", k).over(w) for k in range(1, lags + 1)} | {"u": F.col("r") * F.col("r") - F.lag(b).over(w)})
    events = diagnostics.win_lose(rows, F.col("d"), by=entity)
    return {"rows": rows, "events": diagnostics.event_summary(events, ["d", "loss_a", "loss_b", "u"], ["u"]), "path": diagnostics.mean_path(events, "u", window, entity)}
