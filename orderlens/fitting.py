"""End-to-end fit and apply: tables -> features -> matrix -> model -> scores.

One code path serves training and holdout tables: everything learned
(shipping threshold, response-time mean, one-hot layout, model) is fitted on
the training tables and reused unchanged.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.ml.matrix import MatrixModel, apply_matrix, fit_matrix, split
from orderlens.ml.models import fit_model
from orderlens.plans.base import KEY, LABEL, build_base
from orderlens.plans.items import item_aggregates
from orderlens.plans.products import product_features
from orderlens.plans.state import FeatureState, fit_feature_state
from orderlens.session import stage


@dataclass
class FittedScorer:
    state: FeatureState
    matrix: MatrixModel
    model: object
    kind: str

    def save(self, path: str) -> None:
        """Write state, formula and model under ``path`` (Spark ML writers)."""
        spark = SparkSession.getActiveSession()
        self.state.save(spark, f"{path}/state")
        self.matrix.model.write().overwrite().save(f"{path}/formula")
        self.model.write().overwrite().save(f"{path}/model")
        meta = {"kind": self.kind, "formula": self.matrix.formula,
                "constant_columns": self.matrix.constant_columns, "levels": self.matrix.levels}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
             .write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedScorer":
        from pyspark.ml.classification import (GBTClassificationModel, LogisticRegressionModel,
                                               RandomForestClassificationModel)
        from pyspark.ml.feature import RFormulaModel
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        model_cls = {"gbt": GBTClassificationModel, "lr": LogisticRegressionModel,
                     "rf": RandomForestClassificationModel}[meta["kind"]]
        matrix = MatrixModel(meta["formula"], RFormulaModel.load(f"{path}/formula"), meta["constant_columns"],
                             meta.get("levels", {}))
        return cls(FeatureState.load(spark, f"{path}/state"), matrix, model_cls.load(f"{path}/model"),
                   meta["kind"])


def fit_base(tables: dict[str, DataFrame], complete_only: bool = True,
             rel_err: float = 0.0) -> tuple[FeatureState, DataFrame]:
    """Fitted state plus the staged training base table.

    The per-order item aggregates are computed once and cached: the quantile
    passes read their shipping column, and the base-table join reuses them
    with their ``order_id`` partitioning intact.
    """
    aggs = item_aggregates(tables["order_items"], product_features(tables["products"])) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        state = fit_feature_state(tables, rel_err=rel_err, item_aggs=aggs, response_mean=False)
        base = stage(build_base(tables, state, complete_only, item_aggs=aggs), "base")
    finally:
        aggs.unpersist()
    return state, base


def fit_matrix_split(base: DataFrame, validation: bool = True):
    """Split the staged base, fit the formula on the training part, stage
    both matrices (key, features, label)."""
    if validation:
        parts = split(base, KEY)
        train = parts.filter(F.col("split") == "train").drop("split")
        valid = parts.filter(F.col("split") == "validation").drop("split")
    else:
        train, valid = base, None
    matrix = fit_matrix(train, LABEL, exclude=[KEY])
    tr = stage(apply_matrix(matrix, train).select(KEY, "features", "label"), "train_matrix")
    va = stage(apply_matrix(matrix, valid).select(KEY, "features", "label"), "validation_matrix") \
        if valid is not None else None
    return matrix, tr, va


def fit_scorer(tables: dict[str, DataFrame], kind: str = "gbt", validation: bool = False,
                 **params) -> FittedScorer:
    """Fit state, formula and model on the labelled tables.

    With ``validation`` the model is fitted on the hash-split training part
    only (the 80/20 split of the reference); otherwise on all rows.
    """
    state, base = fit_base(tables)
    matrix, train, _ = fit_matrix_split(base, validation)
    return FittedScorer(state, matrix, fit_model(kind, train, **params), kind)


def score_tables(fitted: FittedScorer, tables: dict[str, DataFrame]) -> DataFrame:
    """Holdout (or any) tables scored with the fitted state and model."""
    base = build_base(tables, fitted.state)
    return fitted.model.transform(apply_matrix(fitted.matrix, base))
