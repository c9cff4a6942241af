"""Fitting, scoring and reading the three classifiers."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: seed for the randomised learners (PySpark's default seed is
# derived from the class name with Python's per-process string hash).
MODEL_SEED = 42

ESTIMATORS = {
    "lr": LogisticRegression,
    "rf": RandomForestClassifier,
    "gbt": GBTClassifier,
}


def make_estimator(kind: str, seed: int = MODEL_SEED, features: str = "features",
                   label: str = "label", **params):
    """Estimator with Spark's defaults unless ``params`` override them."""
    cls = ESTIMATORS[kind]
    est = cls(featuresCol=features, labelCol=label, **params)
    if est.hasParam("seed"):
        est = est.setSeed(seed)
    return est


def fit_model(kind: str, train: DataFrame, seed: int = MODEL_SEED, **params):
    """M3 (lr) / M4 (rf) / M5 (gbt)."""
    return make_estimator(kind, seed, **params).fit(train)


def score(model, df: DataFrame) -> DataFrame:
    """Add rawPrediction / probability / prediction."""
    return model.transform(df)


def predictions(scored: DataFrame, key: str = "order_id") -> DataFrame:
    """The ``(key, prediction)`` output table."""
    return scored.select(key, "prediction")


def prediction_counts(scored: DataFrame) -> DataFrame:
    """Rows per predicted class."""
    return scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("count")).orderBy("prediction")


def feature_names(matrix_df: DataFrame, size: int, features: str = "features") -> list[str]:
    """The names of the vector's ``size`` slots, ``f<index>`` where the column's metadata has none."""
    meta = matrix_df.schema[features].metadata.get("ml_attr", {})
    if meta.get("num_attrs", size) != size:
        raise ValueError(f"the model has {size} features, the matrix {meta['num_attrs']}")
    names = [f"f{k}" for k in range(size)]
    for attribute in chain.from_iterable(meta.get("attrs", {}).values()):
        names[attribute["idx"]] = attribute["name"]
    return names


def feature_importance(model, matrix_df: DataFrame, features: str = "features") -> DataFrame:
    """``(idx, name, score)`` sorted by importance (tree models).

    The vector has one slot per feature (tens of values), so it is read on
    the driver like any model parameter.
    """
    scores = [float(x) for x in model.featureImportances.toArray()]
    named = zip(range(len(scores)), feature_names(matrix_df, len(scores), features), scores)
    return matrix_df.sparkSession.createDataFrame(list(named), "idx int, name string, score double") \
        .orderBy(F.desc("score"), "idx")


def coefficients(model, matrix_df: DataFrame, features: str = "features") -> DataFrame:
    """M9: ``(name, coefficient)`` of a logistic regression, intercept first."""
    coef = model.coefficientMatrix.toArray()[0]
    rows = [("(intercept)", -1, float(model.interceptVector[0]))]
    rows += [(name, i, float(coef[i])) for i, name in enumerate(feature_names(matrix_df, len(coef), features))]
    spark = matrix_df.sparkSession
    return spark.createDataFrame(rows, "name string, idx int, coefficient double").orderBy("idx")


def log_likelihood_gradient(model, matrix_df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """M3: ``(idx, name, gradient)``, the mean gradient of the log-likelihood at the fitted coefficients, intercept first (idx -1).

    All components are near zero at an optimum without regularisation. The matrix is read in blocks of rows; each task adds its
    blocks up to one vector, and only these partial sums, one row per slot and task, are shuffled.
    """
    beta, intercept = model.coefficientMatrix.toArray()[0], float(model.interceptVector[0])
    names = ["(intercept)", *feature_names(matrix_df, len(beta), features)]

    def run(batches):
        total, rows = np.zeros(len(beta) + 1), 0
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, len(beta)))
            rest = batch["y"].to_numpy(float) - 1 / (1 + np.exp(-(x @ beta + intercept)))
            total[0] += rest.sum()
            total[1:] += rest @ x
            rows += len(batch)
        yield pd.DataFrame({"idx": np.arange(-1, len(beta)), "part": total, "rows": rows})

    parts = matrix_df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")) \
        .mapInPandas(run, "idx int, part double, rows long")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("idx") + 2)
    return parts.groupBy("idx").agg((F.sum("part") / F.sum("rows")).alias("gradient")).select("idx", name.alias("name"), "gradient").orderBy("idx")
