"""Queries that fit models; SQL has no word for them, tests hold them to gradients and recovery."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import fanout, smoothing
from ..operators import folds, metrics, store
from ..sources import shared, simulated
from . import validation
from .catalogue import query
from .panels import ES, dataset
from .queries_panel import r8

S = SparkSession
SPECS = {
    "ES": {"kind": "es"},
    "STES": {"kind": "stes", "columns": ["r", "abs_r"], "params": {"restarts": 1}},
    "PGARCH": {"kind": "pgarch", "columns": ["abs_r"]},
    "GARCH": {"kind": "garch"},
}


def _features(spark: S, d: str) -> DataFrame:
    return dataset(spark, d).withColumn("abs_r", F.abs("r"))


@query()
def es_fit(spark: S, d: str) -> DataFrame:
    return fanout.smoother_params(_features(spark, d), {"kind": "es"}).select("entity_id", F.get_json_object("params_json", "$.beta[0]").cast("double").alias("beta"), F.round("loss", 6).alias("loss"))


@query(f"WITH RECURSIVE {ES} SELECT entity_id, model || ':0002' AS model_id, ts_utc, round(yhat, 8) AS yhat FROM es WHERE model = 'es_mid'")
def stored_model_forecasts(spark: S, d: str) -> DataFrame:
    """Two versions of a model written to a store, and the forecasts of the newest by its artifacts as they are read again."""
    import math
    import pickle
    import uuid

    rows = dataset(spark, d)
    kept = store.Store(spark, f"{shared.folder(spark)}/store-{uuid.uuid4().hex}")
    for gate in (0.5, 0.06):
        fitted = fanout.Fitted("es", smoothing.Smoother(["const"], beta=np.array([math.log(gate / (1 - gate))])), [])
        blob = F.lit(bytearray(pickle.dumps(fitted)))
        kept.register("es_mid", {"kind": "es", "gate": gate}, None, None, created="1998-12-01", fitted=rows.groupBy("entity_id").agg(F.count("*").alias("n")).select("entity_id", blob.alias("artifact"), F.lit(0.0).alias("loss"), "n"))
    model_id = kept.latest_model_id("es_mid")
    made = fanout.apply(rows, kept.artifacts(model_id).withColumn("model", F.lit("es_mid")), {"es_mid": {"kind": "es"}})
    return r8(made.select("entity_id", F.lit(model_id).alias("model_id"), "ts_utc", "yhat"), "yhat")


@query()
def model_race(spark: S, d: str) -> DataFrame:
    """Fits of four kinds on the first 1,500 rows, scored on the rest."""
    rows = fanout.forecasts(_features(spark, d), SPECS, train_to=1500).filter("step >= 1500 and y is not null").withColumn("ts_utc", F.col("ts_utc"))
    return r8(metrics.by_model(rows, ["entity_id", "model"]), "qlike", "rmse", "mae", "hit_rate", "corr", digits=5)


@query()
def stes_cv(spark: S, d: str) -> DataFrame:
    """Penalties by expanding blocks of each entity's own rows, with and without the adaptive weights of a ridge pilot."""
    ways = [(p, a) for p in (0.0, 0.01, 0.1) for a in ((False, True) if p else (False,))]
    specs = {f"l2={p:g}{' adaptive' if a else ''}": {"kind": "stes", "columns": ["abs_r"], "params": {"l2": p, "restarts": 1, "adaptive": a}} for p, a in ways}
    scores = fanout.fold_scores(folds.block_rows(_features(spark, d), 3, ["entity_id"]), specs)
    return r8(fanout.best(scores), "score", digits=5)


@query()
def boosted_fits(spark: S, d: str) -> DataFrame:
    specs = {
        "XGBSTES": {"kind": "xgb_stes", "columns": ["r", "abs_r"], "params": {"rounds": 15}},
        "XGBPGARCH": {"kind": "xgb_pgarch", "columns": ["abs_r"], "params": {"rounds": 4}},
        "VOLGRU": {"kind": "gated", "columns": ["r", "abs_r"], "params": {"epochs": 20}},
    }
    rows = fanout.forecasts(_features(spark, d), specs, train_to=1000).filter("step >= 1000 and y is not null")
    return r8(metrics.by_model(rows, ["entity_id", "model"]), "qlike", "rmse", "mae", "hit_rate", "corr", digits=5)


@query()
def simulated_study(spark: S, d: str) -> DataFrame:
    """Every kind of model fitted to each series and to permutations of it, which have no volatility to follow, and the spread of the error over these."""
    from ..operators.panel import to_steps
    from ..operators.windows import by_entity

    rows = dataset(spark, d).select("entity_id", "ts_utc", "r")
    rows = simulated.permuted(rows, "r", simulated.study_seeds(3)).withColumn("entity_id", F.concat_ws("#", "entity_id", "seed")).drop("seed").unionByName(rows)
    rows = rows.withColumn("abs_r", F.abs("r")).withColumn("y", F.pow(F.lead("r").over(by_entity()), 2)).dropna(subset=["y"])
    made = fanout.forecasts(to_steps(rows), SPECS, train_to=400).filter("step >= 400")
    errors = made.groupBy("entity_id", "model").agg(metrics.rmse().alias("rmse"))
    return r8(metrics.seeds(errors.withColumn("permuted", F.contains("entity_id", F.lit("#"))), ["model", "permuted"], "rmse"), "mean", "std", "std_pop", digits=6)


@query()
def multi_init_study(spark: S, d: str) -> DataFrame:
    """Smoothers refitted from several starts, of each the best seed out of sample, and its coefficients side by side."""
    specs = {"ES": {"kind": "es", "params": {"restarts": 1}}, "STES_A": {"kind": "stes", "columns": ["abs_r"], "params": {"restarts": 1}}, "STES_RA": {"kind": "stes", "columns": ["r", "abs_r"], "params": {"restarts": 1}}}
    made = fanout.study(_features(spark, d), specs, range(4), 1500)
    return r8(fanout.wide_coefficients(fanout.best_seed(made), list(specs)), *specs, digits=4)


@query()
def parameter_search(spark: S, d: str) -> DataFrame:
    base = {"kind": "stes", "columns": ["abs_r"], "params": {"restarts": 1}}
    return r8(fanout.search(_features(spark, d), base, {"l2": [0.0, 0.001, 0.01, 0.1], "adaptive": [False, True]}, 4), "score", digits=5)


@query()
def volgru_cv(spark: S, d: str) -> DataFrame:
    """Gated candidates by expanding folds, and how many epochs the best one's folds took."""
    params = {"valid": 0.2, "epochs": 12, "patience": 3}
    specs = {c: {"kind": "gated", "columns": ["abs_r"], "params": params | {"candidate": c}} for c in ("r2", "mlp_pos")}
    rows = folds.block_rows(_features(spark, d), 2, ["entity_id"])
    return r8(fanout.best(fanout.fold_scores(rows, specs)), "score", digits=5)


@query()
def rolling_validation(spark: S, d: str) -> DataFrame:
    """Models refitted on each rolling window of each entity: gains, ranks and tests of the smooth-transition gate against two baselines."""
    made = validation.rolling_forecasts(_features(spark, d), {m: SPECS[m] for m in ("ES", "STES", "GARCH")}, 1000, 400, 400)
    out = validation.candidate_rows(made, "STES", ["ES", "GARCH"], ["entity_id", "window_no"])
    return r8(out, *(c for c, kind in out.dtypes if kind == "double"), digits=4)


@query()
def candidate_search(spark: S, d: str) -> DataFrame:
    """A candidate of each family against a baseline, over all rolling windows."""
    tried = validation.chosen(validation.families(["abs_r"]), ["screen_g", "boost_g", "gated_r2"])
    out = validation.try_candidates(_features(spark, d), tried, {"ES": SPECS["ES"]}, 1200, 800, 800)
    return r8(out.drop("runtime_seconds"), *(c for c, kind in out.dtypes if kind == "double" and c != "runtime_seconds"), digits=4)


@query()
def feature_importance(spark: S, d: str) -> DataFrame:
    return fanout.importances(_features(spark, d), {"kind": "xgb_stes", "columns": ["r", "abs_r"], "params": {"rounds": 10}})


@query()
def recurrent_fits(spark: S, d: str) -> DataFrame:
    """Small recurrent networks, as variances and as gates, on the first 800 rows, scored on the rest."""
    specs = {k.upper(): {"kind": k, "columns": ["r", "abs_r"], "params": {"epochs": 10, "hidden": 3}} for k in ("rnn", "gru", "rnn_stes")}
    rows = fanout.forecasts(_features(spark, d), specs, train_to=800).filter("step >= 800 and y is not null")
    return r8(metrics.by_model(rows, ["entity_id", "model"]), "qlike", "rmse", "mae", "hit_rate", "corr", digits=5)
