"""M6-M8: parameter grid, k-fold cross-validation, best parameters."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.ml.matrix import fold_column
from orderlens.ml.models import MODEL_SEED

# The reference's boosted-tree grid (2 x 2 x 2).
GBT_GRID = {"maxDepth": [5, 7], "maxIter": [20, 50], "stepSize": [0.05, 0.1]}


def grid(estimator, **axes) -> list:
    """M6: every combination of the given parameter values."""
    builder = ParamGridBuilder()
    for name, values in axes.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def tune(estimator, param_maps: list, train: DataFrame, key: str = "order_id", folds: int = 2,
         metric: str = "accuracy", seed: int = MODEL_SEED, parallelism: int = 1) -> CrossValidatorModel:
    """M7: k-fold CV; folds come from a hash of ``key`` so they are fixed.

    ``parallelism`` > 1 fits several grid points at once (each fit is itself
    a distributed job); the refit on all rows uses the best point.
    """
    data = train.withColumn("_fold", fold_column(key, folds))
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=param_maps,
                        evaluator=MulticlassClassificationEvaluator(metricName=metric),
                        numFolds=folds, foldCol="_fold", seed=seed, parallelism=parallelism)
    return cv.fit(data)


def fold_metrics(estimator, param_maps: list, train: DataFrame, key: str = "order_id", folds: int = 2,
                 parallelism: int = 1) -> DataFrame:
    """M7 in full: ``fold, point, params, rows, accuracy``, one row per fold and grid point, and their means (fold null).

    The folds are those of ``tune``. All grid points of a fold score its held-out rows in one pass, side by side; the
    scores of all folds become (fold, point, label, prediction) rows and one aggregation by (fold, point) evaluates them.
    A mean is the plain mean over the folds, as the cross-validator takes it.
    """
    data = train.withColumn("_fold", fold_column(key, folds))
    spark, label = train.sparkSession, estimator.getLabelCol()
    jobs = [(fold, point) for fold in range(folds) for point in range(len(param_maps))]
    fit = inheritable_thread_target(spark)(lambda job: estimator.fit(data.where(F.col("_fold") != job[0]), param_maps[job[1]]))
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        models = dict(zip(jobs, pool.map(fit, jobs)))
    scored = None
    for fold in range(folds):
        held = data.where(F.col("_fold") == fold).select("_fold", label, estimator.getFeaturesCol())
        for point in range(len(param_maps)):
            model = models[fold, point].copy()
            model.setPredictionCol(f"_p{point}").setRawPredictionCol("").setProbabilityCol("")
            held = model.transform(held)
        part = held.select(F.col("_fold").alias("fold"), F.col(label).alias("label"), F.posexplode(
            F.array(*[f"_p{point}" for point in range(len(param_maps))])).alias("point", "prediction"))
        scored = part if scored is None else scored.unionByName(part)
    hit = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    per_fold = scored.groupBy("fold", "point").agg(F.count(F.lit(1)).alias("rows"), hit.alias("accuracy"))
    means = per_fold.groupBy("point").agg(F.lit(None).cast("int").alias("fold"), F.sum("rows").alias("rows"), F.avg("accuracy").alias("accuracy"))
    names = spark.createDataFrame([(k, ", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name))) for k, m in enumerate(param_maps)],
                                  "point int, params string")
    return per_fold.unionByName(means).join(names, "point").select("fold", "point", "params", "rows", "accuracy")


def best_params(cv_model: CrossValidatorModel, names: list[str] | None = None) -> dict:
    """M8: the best model's values of the tuned parameters."""
    best = cv_model.bestModel
    maps = cv_model.getEstimatorParamMaps()
    names = names or sorted({p.name for m in maps for p in m})
    return {n: best.getOrDefault(best.getParam(n)) for n in names}


def cv_summary(cv_model: CrossValidatorModel, spark) -> DataFrame:
    """Mean fold metric per grid point, best first."""
    maps = cv_model.getEstimatorParamMaps()
    names = sorted({p.name for m in maps for p in m})
    rows = []
    for m, score in zip(maps, cv_model.avgMetrics):
        vals = {p.name: v for p, v in m.items()}
        rows.append((", ".join(f"{n}={vals[n]}" for n in names), float(score)))
    return spark.createDataFrame(rows, "params string, metric double").orderBy("metric", ascending=False)
