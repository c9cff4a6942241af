"""Accuracy, confusion matrix, ROC points, exact AUC and gains curve.

All metrics are aggregations over the scored rows; nothing is collected.
Curves have one point per distinct score (rows with equal scores cannot be
ordered, so they enter together), built by ``running_totals`` over the
per-score counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.operators.cumulative import running_totals
from orderlens.session import stage

# Fixed value: the two classes of the binary label.
CLASSES = (0.0, 1.0)


def positive_probability(col: str = "probability") -> Column:
    """The positive-class element of a probability vector column."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))[1]


def _hits(label, prediction, n) -> Column:
    """Rows whose prediction is their label; a row without either is a miss."""
    return F.sum(F.when(F.col(label) == F.col(prediction), n).otherwise(F.lit(0)))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows with ``prediction == label`` (and the row count).
    A null label or prediction counts as a miss."""
    return df.agg((_hits(label, prediction, F.lit(1)) / F.count(F.lit(1))).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def _confusion(cells: DataFrame, label: str, prediction: str, n: Column, classes) -> DataFrame:
    """One row per label, one column per class, from weighted cells; a prediction that is
    none of the classes (null too) fails the query instead of vanishing."""
    known = F.coalesce(F.col(prediction).isin(*classes), F.lit(False))
    checked = F.when(known, n).otherwise(F.raise_error(F.lit("prediction outside the given classes")).cast("long"))
    columns = [F.sum(F.when(F.col(prediction) == c, checked).when(known, F.lit(0)).otherwise(checked)).alias(str(c))
               for c in classes]
    return cells.groupBy(label).agg(*columns).orderBy(label)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes=CLASSES) -> DataFrame:
    """Label rows x prediction columns of counts; absent cells are 0.

    One aggregation with a column per given class, so a class that is never
    predicted still gets its column; the cells sum to the number of rows.
    """
    return _confusion(df, label, prediction, F.lit(1).cast("long"), classes)


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives, negatives and rows per distinct score (partially aggregated)."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1.0).alias("pos"),
        F.count_if(F.col(label) != 1.0).alias("neg"),
    ).withColumn("rows", F.col("pos") + F.col("neg"))


def curve_table(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score with running and total positives,
    negatives and rows in score-descending order (input of E3-E5)."""
    return running_totals(score_counts(df, label, score), "score", ["pos", "neg", "rows"],
                          descending=True)


def _curve(df, label, score, curve):
    return curve if curve is not None else curve_table(df, label, score)


def roc_points(df: DataFrame | None = None, label: str = "label", score: str = "score",
               curve: DataFrame | None = None) -> DataFrame:
    """``(threshold, tp, fp, tpr, fpr)`` for every distinct score.

    A point says: predicting positive for scores >= threshold gives these
    rates. The curve starts at (0, 0) with a null threshold (nothing is
    predicted positive) and ends at (1, 1) at the lowest score; a table
    without rows has no points. Pass a staged ``curve_table`` to share it.
    """
    c = _curve(df, label, score, curve)
    start = c.groupBy("total_pos", "total_neg").agg(F.lit(0).cast("long").alias("cum_pos"), F.lit(0).cast("long").alias("cum_neg")) \
        .withColumn("score", F.lit(None).cast(c.schema["score"].dataType))
    points = c.select("score", "cum_pos", "cum_neg", "total_pos", "total_neg").unionByName(start)
    return points.select(
        F.col("score").alias("threshold"),
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
        F.try_divide(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
    )


def roc_corners(df: DataFrame | None = None, label: str = "label", score: str = "score",
                counts: DataFrame | None = None, rows_per_range: int = 1_000_000) -> DataFrame:
    """E3 without the points that a drawn curve does not need: ``(threshold, tp, fp, tpr, fpr)``.

    A point is left out when the step after it equals the step before it (as many positives and as many negatives), so that
    it lies in the middle of a straight line; the first and the last point, and (0, 0) with a null threshold, always stay.
    The step after a point is that of the next score, also where that score lies in the next value range. Pass
    staged ``score_counts`` to share them.
    """
    counts, staged = (score_counts(df, label, score), False) if counts is None else (counts, True)
    c = running_totals(counts, "score", ["pos", "neg"], descending=True, rows_per_range=rows_per_range,
                       following=["pos", "neg"], staged=staged)
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    bend = F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    return roc_points(curve=c.where(first | bend))


def auc(df: DataFrame | None = None, label: str = "label", score: str = "score",
        curve: DataFrame | None = None) -> DataFrame:
    """Exact area under the ROC curve (ties as diagonal segments).

    Sum over distinct scores of ``neg * (tp_above + pos / 2)`` divided by
    ``P * N``, with the numerator summed exactly as an integer (twice the
    area), so the result does not depend on partitioning. Null when one
    class is absent (the area is undefined).
    """
    c = _curve(df, label, score, curve)
    twice = (F.col("neg").cast("decimal(38,0)")
             * (F.lit(2) * (F.col("cum_pos") - F.col("pos")) + F.col("pos")).cast("decimal(38,0)"))
    agg = c.agg(F.sum(twice).alias("num"), F.max("total_pos").alias("p"), F.max("total_neg").alias("n"))
    return agg.select(
        F.try_divide(F.col("num").cast("double"),
                     F.lit(2.0) * F.col("p").cast("double") * F.col("n").cast("double")).alias("auc"))


def gains_curve(df: DataFrame | None = None, label: str = "label", score: str = "score",
                curve: DataFrame | None = None) -> DataFrame:
    """E5: cumulative gains and lift over score-descending rows.

    ``fraction`` = share of rows at or above the threshold, ``gain`` = share
    of all positives among them, ``lift`` = gain / fraction.
    """
    c = _curve(df, label, score, curve)
    fraction = F.col("cum_rows") / F.col("total_rows")
    gain = F.try_divide(F.col("cum_pos"), F.col("total_pos"))
    return c.select(F.col("score").alias("threshold"), fraction.alias("fraction"),
                    gain.alias("gain"), (gain / fraction).alias("lift"))


def evaluation_report(scored: DataFrame, label: str = "label", score: str = "score",
                      prediction: str = "prediction", classes=CLASSES) -> dict[str, DataFrame]:
    """E1-E5 for one scored table, scoring it once.

    The rows collapse into counts per ``(score, label, prediction)``, which is
    staged; accuracy, the confusion matrix and the per-score curve (also
    staged, shared by ROC, AUC and gains) all derive from that table.
    """
    cells = stage(scored.groupBy(F.col(score).alias("score"), F.col(label).alias("label"),
                                 F.col(prediction).alias("prediction"))
                        .agg(F.count(F.lit(1)).alias("n")), "score_cells")
    acc = cells.agg((_hits("label", "prediction", F.col("n")) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    confusion = _confusion(cells, "label", "prediction", F.col("n"), classes)
    counts = stage(cells.groupBy("score").agg(
        F.sum(F.when(F.col("label") == 1.0, F.col("n")).otherwise(F.lit(0))).alias("pos"),
        F.sum(F.when(F.col("label") != 1.0, F.col("n")).otherwise(F.lit(0))).alias("neg"),
    ).withColumn("rows", F.col("pos") + F.col("neg")), "score_counts")
    curve = stage(running_totals(counts, "score", ["pos", "neg", "rows"], descending=True, staged=True), "curve")
    return {
        "accuracy": acc,
        "confusion": confusion,
        "roc": roc_points(curve=curve),
        "auc": auc(curve=curve),
        "gains": gains_curve(curve=curve),
    }


def evaluator_auc(df: DataFrame, label: str = "label", raw: str = "rawPrediction",
                  bins: int = 1000) -> float:
    """The reference's metric: Spark's evaluator (binned when ``bins > 0``)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw, numBins=bins)
    return ev.evaluate(df)
