"""The whole analysis in one call: profile, features, base table, matrix,
optional tuning, three classifiers, metrics, importance, curves and holdout
predictions. Every output is a DataFrame (or a small fitted object)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.fitting import FittedScorer, fit_base, fit_matrix_split, score_tables
from orderlens.ml import evaluation as ev
from orderlens.ml.models import (coefficients, feature_importance, fit_model, make_estimator,
                                 prediction_counts, predictions)
from orderlens.ml.tuning import GBT_GRID, best_params, grid, tune
from orderlens.operators.cleaning import drop_empty_rows
from orderlens.operators.quality import duplicate_count, null_counts, null_counts_long
from orderlens.plans.base import KEY
from orderlens.sources.sinks import write_predictions

MODEL_KINDS = ("gbt", "lr", "rf")


@dataclass
class FlowResult:
    state: object
    matrix: object
    models: dict
    metrics: DataFrame
    importance: DataFrame
    coefficients: DataFrame
    report: dict
    profiles: dict = field(default_factory=dict)
    best_params: dict | None = None
    predictions: DataFrame | None = None
    prediction_counts: DataFrame | None = None
    scorer: FittedScorer | None = None


def model_reports(models: dict, valid: DataFrame) -> dict[str, dict[str, DataFrame]]:
    """The evaluation report of every model; each scores the validation rows once."""
    return {kind: ev.evaluation_report(model.transform(valid).select("label", ev.positive_probability().alias("score"), "prediction"))
            for kind, model in models.items()}


def model_metrics(models: dict, valid: DataFrame, binned_auc: bool = False,
                  reports: dict[str, dict[str, DataFrame]] | None = None) -> DataFrame:
    """``(model, metric, value)``: validation accuracy and exact AUC per model
    (and the evaluator's 1000-bin AUC with ``binned_auc``), from ``reports`` if these are made already."""
    spark = valid.sparkSession
    reports = model_reports(models, valid) if reports is None else reports
    parts = []
    for kind, model in models.items():
        rep = reports[kind]
        parts.append(rep["accuracy"].select(F.lit(kind).alias("model"), F.lit("accuracy").alias("metric"),
                                            F.col("accuracy").alias("value")))
        parts.append(rep["auc"].select(F.lit(kind).alias("model"), F.lit("auc").alias("metric"),
                                       F.col("auc").alias("value")))
        if binned_auc:
            parts.append(spark.range(1).select(F.lit(kind).alias("model"), F.lit("auc_binned").alias("metric"),
                                               F.lit(ev.evaluator_auc(model.transform(valid))).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_flow(train_tables: dict[str, DataFrame], holdout_tables: dict[str, DataFrame] | None = None,
             kinds=MODEL_KINDS, tune_gbt: bool = False, tune_grid: dict | None = None, folds: int = 2,
             params: dict | None = None, predictions_path: str | None = None) -> FlowResult:
    """Fit everything on the labelled tables and score the holdout tables.

    Rows without any value are dropped from every table first.

    ``params`` maps a model kind to parameter overrides (defaults are
    Spark's, as in the reference). With ``tune_gbt`` a cross-validated grid
    search (the reference's 2x2x2 grid unless ``tune_grid``) runs first and
    its best parameters are reported; the final boosted-tree model keeps
    defaults unless ``params`` says otherwise, as the reference does.
    """
    params = params or {}
    train_tables = {name: drop_empty_rows(df) for name, df in train_tables.items()}
    profiles = {name: null_counts(df) for name, df in train_tables.items()}
    state, base = fit_base(train_tables)
    profiles["base_nulls"] = null_counts_long(base)
    profiles["base_duplicates"] = duplicate_count(base)
    matrix, train, valid = fit_matrix_split(base)
    tuned = None
    if tune_gbt:
        est = make_estimator("gbt")
        cv = tune(est, grid(est, **(tune_grid or GBT_GRID)), train, key=KEY, folds=folds)
        tuned = best_params(cv)
    models = {kind: fit_model(kind, train, **params.get(kind, {})) for kind in kinds}
    reports = model_reports(models, valid)
    metrics = model_metrics(models, valid, reports=reports)
    best_kind = "gbt" if "gbt" in models else next(iter(models))
    best = models[best_kind]
    result = FlowResult(
        state=state, matrix=matrix, models=models, metrics=metrics,
        importance=feature_importance(best, train) if hasattr(best, "featureImportances") else None,
        coefficients=coefficients(models["lr"], train) if "lr" in models else None,
        report=reports[best_kind], profiles=profiles, best_params=tuned,
    )
    fitted = FittedScorer(state, matrix, best, best_kind)
    result.scorer = fitted
    if holdout_tables is not None:
        holdout_scored = score_tables(fitted, {name: drop_empty_rows(df) for name, df in holdout_tables.items()})
        result.predictions = predictions(holdout_scored)
        result.prediction_counts = prediction_counts(holdout_scored)
        if predictions_path:
            write_predictions(result.predictions, predictions_path)
    return result
