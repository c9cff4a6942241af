"""Relational feature slots against the formula's vectors, fold metrics against the cross-validator, the gradient."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF_MID
from orderlens import catalog
from orderlens.ml.matrix import apply_matrix, fit_matrix, fold_column
from orderlens.ml.models import fit_model, log_likelihood_gradient, make_estimator
from orderlens.ml.slots import apply_slots, dense, fit_slots, level_ranks
from orderlens.ml.tuning import fold_metrics, grid, tune
from orderlens.plans.base import KEY, LABEL
from orderlens.session import stage


@pytest.fixture(scope="module")
def base(spark):
    return stage(catalog.f21_base_table(spark, SF_MID), "slots-test-base")


def test_slots_equal_the_formula(spark, base):
    train = base.where(F.col(KEY) % 5 != 0)
    other = base.withColumn("primary_payment_type", F.when(F.col(KEY) % 3 == 0, "never seen").when(F.col(KEY) % 7 == 0, None)
                            .otherwise(F.col("primary_payment_type")))
    model, matrix = fit_slots(train, LABEL, [KEY]), fit_matrix(train, LABEL, exclude=[KEY])
    got = {r[KEY]: r["v"] for r in apply_slots(model, other, [KEY]).select(KEY, dense(size=model.size).alias("v")).collect()}
    want = {r[KEY]: r["v"] for r in apply_matrix(matrix, other).select(KEY, vector_to_array("features").alias("v")).collect()}
    assert len(got) == base.count() and got == want and model.size == len(next(iter(want.values())))


def test_levels_stay_in_a_table(spark):
    rows = [(k, f"v{k % 1000}" if k % 10 else "hot", "only", None) for k in range(20_000)]
    df = spark.createDataFrame(rows, "y int, many string, one string, none string")
    ranks = {r["level"]: r["rank"] for r in level_ranks(df, ["many"]).collect()}
    assert ranks["hot"] == 0 and sorted(ranks.values()) == list(range(901))
    same = sorted(x for x in ranks if x != "hot")
    assert [ranks[x] for x in same] == list(range(1, 901))                # equally frequent: alphabetical
    model = fit_slots(df, "y")
    assert model.columns == [("many", 0, 901)] and model.size == 900
    got = apply_slots(model, spark.createDataFrame([(1, "hot", "x", "y"), (2, same[-1], None, None), (3, None, None, None), (4, "?", None, None)],
                                                   "y int, many string, one string, none string"), ["y"]).collect()
    assert {r["y"]: r["slots"] for r in got} == {1: [0], 2: [], 3: [], 4: []}


def test_clashing_names(spark):
    df = spark.createDataFrame([(k, f"a{k % 3}", float(k % 2), "x") for k in range(30)], "y int, level string, rank double, _row string")
    model = fit_slots(df, "y", ["_row"])
    assert apply_slots(model, df, ["y", "_row"]).count() == 30 and model.size == 3


def test_fold_metrics_equal_the_cross_validator(spark, base):
    train = stage(apply_matrix(fit_matrix(base, LABEL, exclude=[KEY]), base).select(KEY, "features", "label"), "folds-test")
    est = make_estimator("gbt", maxIter=3)
    points = grid(est, maxDepth=[2, 4], stepSize=[0.1, 0.3])
    rows = fold_metrics(est, points, train, folds=2, parallelism=4).collect()
    assert len(rows) == 2 * 4 + 4
    means = {r["point"]: r for r in rows if r["fold"] is None}
    cv = tune(est, points, train, folds=2, parallelism=4)
    assert [means[k]["accuracy"] for k in range(4)] == pytest.approx(cv.avgMetrics, abs=1e-12)
    assert all(r["rows"] == train.count() for r in means.values())
    sizes = {r["fold"]: r["count"] for r in train.groupBy(fold_column(KEY, 2).alias("fold")).count().collect()}
    assert {(r["fold"], r["rows"]) for r in rows if r["fold"] is not None} == set(sizes.items())
    assert means[0]["params"] == "maxDepth=2, stepSize=0.1"


def test_gradient_at_the_optimum(spark, base):
    matrix = stage(apply_matrix(fit_matrix(base, LABEL, exclude=[KEY]), base).select("features", "label"), "gradient-test")
    model = fit_model("lr", matrix, tol=1e-10, maxIter=500)
    rows = log_likelihood_gradient(model, matrix).collect()
    assert [r["idx"] for r in rows] == list(range(-1, len(rows) - 1)) and rows[0]["name"] == "(intercept)"
    data = matrix.select(vector_to_array("features").alias("x"), "label").collect()
    x, y = np.array([r["x"] for r in data]), np.array([r["label"] for r in data])
    rest = y - 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    want = [rest.mean(), *(rest @ x / len(y))]
    spread = np.concatenate([[1.0], x.std(0) + 1e-9])
    assert [r["gradient"] for r in rows] == pytest.approx(want, abs=1e-9 * np.abs(x).max())
    assert np.abs(np.array(want) / spread).max() < 1e-3
    early = log_likelihood_gradient(fit_model("lr", matrix, maxIter=1), matrix).collect()
    assert max(abs(r["gradient"]) for r in early) > 10 * max(abs(r["gradient"]) for r in rows)


def test_too_many_levels_are_an_error(spark):
    from orderlens.ml.matrix import text_levels
    df = spark.range(30).selectExpr("cast(id as string) AS a", "cast(id % 2 as string) AS b", "cast(null as string) AS c")
    got = text_levels(df, ["a", "b", "c"], most=32)
    assert len(got["a"]) == 30 and got["b"] == ["0", "1"] and got["c"] == []
    with pytest.raises(ValueError, match="more than 31 levels"):
        text_levels(df, ["a", "b", "c"], most=31)
