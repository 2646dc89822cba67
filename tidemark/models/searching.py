"""Adaptive parameter search: proposals from what scored well, and halving of what does not, for many series at once."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.folds import block_rows
from ..sources.shared import checkpoint
from . import fanout


@dataclass(frozen=True)
class Span:
    """Numbers from ``low`` to ``high``, by their logarithm or in whole steps where asked."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def unit(self, x: float) -> float:
        f = math.log if self.log else float
        return (f(x) - f(self.low)) / (f(self.high) - f(self.low))

    def value(self, u: float) -> float | int:
        x = self.low * (self.high / self.low) ** u if self.log else self.low + (self.high - self.low) * u
        return int(round(x)) if self.whole else x


#: A parameter: a span of numbers, or a list of what it may be.
Space = dict[str, Span | Sequence[Any]]


def drawn(space: Space, g: np.random.Generator) -> dict[str, Any]:
    return {p: s.value(float(g.uniform())) if isinstance(s, Span) else s[int(g.integers(len(s)))] for p, s in space.items()}


def proposed(space: Space, seen: Sequence[dict[str, Any]], n: int, g: np.random.Generator, share: float = 0.25, tries: int = 24) -> list[dict[str, Any]]:
    """``n`` parameter sets where the best ``share`` of ``seen`` (best first) is dense against the rest.

    Parzen's estimator, a parameter at a time: a normal about each good value, whose width falls as there are more of them, and a uniform part; of lists, counts and one each. Of ``tries``
    draws from the good ones' density for each proposal, that of the largest ratio to the others' is taken.
    """
    cut = max(2, math.ceil(share * len(seen)))
    good, rest = seen[:cut], seen[cut:] or seen

    def density(p: str, values: Sequence[Any], x: Any) -> float:
        s = space[p]
        if not isinstance(s, Span):
            return (1 + sum(v == x for v in values)) / (len(s) + len(values))
        width, u = max(0.03, 1 / (1 + len(values))), s.unit(x)
        bells = sum(math.exp(-0.5 * ((u - s.unit(v)) / width) ** 2) / width / math.sqrt(2 * math.pi) for v in values)
        return (1 + bells) / (1 + len(values))

    def near_good() -> dict[str, Any]:
        out, width = {}, max(0.03, 1 / (1 + len(good)))
        for p, s in space.items():
            at = good[int(g.integers(len(good)))][p]
            if isinstance(s, Span):
                out[p] = s.value(float(np.clip(s.unit(at) + width * g.normal(), 0, 1)))
            else:
                out[p] = at if g.uniform() < len(good) / (len(good) + len(s)) else s[int(g.integers(len(s)))]
        return out

    def gain(x: dict[str, Any]) -> float:
        return sum(math.log(density(p, [v[p] for v in good], x[p]) / density(p, [v[p] for v in rest], x[p])) for p in space)

    return [max((near_good() for _ in range(tries)), key=gain) for _ in range(n)]


def adaptive_search(df: DataFrame, base: fanout.Spec, space: Space, rounds: int = 4, per_round: int = 8, splits: int = 4, keep: float = 0.5, seed: int = 0, by: Sequence[str] = ("entity_id",), loss: str = "mse") -> tuple[DataFrame, DataFrame]:
    """((by, params_json, score, fits), all candidates): of each series the parameter set of the lowest mean loss over its expanding folds, and how many fold fits were spent on it.

    The first round draws at random, each later one where the series' own good candidates so far are dense (``proposed``). A round goes by rungs: all its candidates
    are fitted on the first fold, the best ``keep`` of each series on the second, and so on; what is left at the last fold is compared.
    A rung is one job over (series, candidate, fold), proposals are one over the series; the driver sees nothing of
    them. Draws hang on seed, series and round alone, so that reruns agree.
    """
    rows = checkpoint(block_rows(df, splits, list(by)))
    columns = list(base.get("columns", []))
    keys = [f for f in rows.schema.fields if f.name in by]
    text, number, whole = T.StringType(), T.DoubleType(), T.LongType()
    key_schema = lambda *more: T.StructType([*keys, *more])
    candidate = T.StructField("candidate", text), T.StructField("params_json", text)

    def propose(round_: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            name = "|".join(str(group[c].iloc[0]) for c in by)
            g = np.random.default_rng([seed, round_, zlib.crc32(name.encode())])
            known = group.dropna(subset=["score"]).sort_values(["folds", "score", "candidate"], ascending=[False, True, True])
            made = proposed(space, [json.loads(p) for p in known["params_json"]], per_round, g) if len(known) > 1 else [drawn(space, g) for _ in range(per_round)]
            out = pd.DataFrame({"candidate": [f"r{round_:02d}c{k:03d}" for k in range(per_round)], "params_json": [json.dumps(p, sort_keys=True) for p in made]})
            return out.assign(**{c: group[c].iloc[0] for c in by})[[*by, "candidate", "params_json"]]

        return run

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        spec = base | {"params": base.get("params", {}) | json.loads(group["params_json"].iloc[0])}
        return group[[*by, "candidate", "params_json"]].head(1).assign(score=float(fanout.fold_value(spec, group, loss)[0]))

    series = rows.select(*by).distinct()
    seen: DataFrame | None = None
    for round_ in range(rounds):
        told = series.withColumns({"candidate": F.lit(None).cast(text), "params_json": F.lit(None).cast(text), "score": F.lit(None).cast(number), "folds": F.lit(0).cast(whole)})
        told = told if seen is None else told.unionByName(seen.select(told.columns))
        alive = checkpoint(told.groupBy(*by).applyInPandas(propose(round_), key_schema(*candidate)))
        scored = alive.withColumns({"total": F.lit(0.0), "folds": F.lit(0).cast(whole)})
        for fold in range(splits):
            own = rows.filter((F.col("fold") == fold) & (F.col("train_to") > 1)).select(*dict.fromkeys([*by, "step", *columns, "y", "r", "train_to"]))
            fan = own.join(alive, list(by))
            made = fanout.spread(fan, *by, "candidate").groupBy(*by, "candidate").applyInPandas(fit, key_schema(*candidate, T.StructField("score", number)))
            scored = checkpoint(scored.join(made.select(*by, "candidate", F.col("score").alias("_new")), [*by, "candidate"], "left").select(*by, "candidate", "params_json", (F.col("total") + F.coalesce("_new", F.lit(0.0))).alias("total"), (F.col("folds") + F.col("_new").isNotNull().cast("long")).alias("folds")))
            last = scored.filter(F.col("folds") == fold + 1).withColumn("_mean", F.col("total") / F.col("folds"))
            best = F.row_number().over(W.partitionBy(*by).orderBy("_mean", "candidate"))
            size = F.count("*").over(W.partitionBy(*by))
            alive = last.withColumns({"_rank": best, "_of": size}).filter(F.col("_rank") <= F.ceil(F.col("_of") * keep)).select(*by, "candidate", "params_json")
        now = scored.filter("folds > 0").select(*by, "candidate", "params_json", (F.col("total") / F.col("folds")).alias("score"), "folds")
        seen = checkpoint(now if seen is None else seen.unionByName(now))
    done = F.when(F.col("folds") == splits, F.struct("score", "candidate", "params_json"))
    found = seen.groupBy(*by).agg(F.min(done).alias("b"), F.sum("folds").alias("fits")).select(*by, "b.params_json", "b.score", "fits")
    return found, seen
