"""Staged tables are dropped at the end of a block, and only those made inside it."""

import os

import pytest

from orderlens.session import checkpoint_root, dropping_staged, materialize, stage


def folders(spark):
    root = checkpoint_root(spark).removeprefix("file:") + "/orderlens"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_block_drops_what_it_staged(spark):
    outside = materialize(spark.range(10), "outside")
    before = folders(spark)
    with dropping_staged(spark):
        inner = stage(spark.range(100), "inner")
        assert inner.count() == 100 and len(folders(spark) - before) == 1
        with dropping_staged(spark):
            stage(spark.range(5), "nested")
            assert len(folders(spark) - before) == 2
        assert len(folders(spark) - before) == 1 and inner.count() == 100
    assert folders(spark) == before and outside.count() == 10
    after = stage(spark.range(3), "later")                  # no block is open any more
    assert after.count() == 3 and len(folders(spark) - before) == 1


def test_block_drops_after_a_failure(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), dropping_staged(spark):
        stage(spark.range(100), "lost")
        1 / 0
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"), dropping_staged(spark):
        stage(spark.range(100).selectExpr("id / 0 AS x"), "broken")
    assert folders(spark) == before


def test_persisted_tables_are_released(spark, monkeypatch):
    from orderlens import session
    monkeypatch.setattr(session, "checkpoint_root", lambda *_, **__: None)
    with dropping_staged(spark):
        held = stage(spark.range(7), "held")
        assert held.is_cached
    assert not held.is_cached


def test_best_model_is_scored_once(spark):
    """The report of the flow is the one its metrics are made of."""
    from orderlens import flow
    calls = []

    class Model:
        def transform(self, df):
            calls.append(df)
            return df.selectExpr("label", "prediction", "probability")

    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([(float(k % 2), float(k % 3 == 0), [1 - k / 20, k / 20]) for k in range(20)],
                                 "label double, prediction double, p array<double>")
    valid = rows.withColumn("probability", array_to_vector("p")).select("label", "prediction", "probability")
    models = {"one": Model(), "two": Model()}
    reports = flow.model_reports(models, valid)
    got = {(r["model"], r["metric"]): r["value"] for r in flow.model_metrics(models, valid, reports=reports).collect()}
    assert len(calls) == 2 and set(got) == {(k, x) for k in models for x in ("accuracy", "auc")}
    assert got["one", "auc"] == reports["one"]["auc"].first()["auc"]
    right = rows.where(F.col("label") == F.col("prediction")).count() / 20
    assert got["one", "accuracy"] == pytest.approx(right)
