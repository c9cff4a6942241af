"""Review features per order (the label source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.expressions import day_span, flag
from orderlens.operators.cleaning import impute_mean, require
from orderlens.operators.ranking import latest_per_key

# Fixed value: scores at or above this cut are a satisfied customer.
POSITIVE_CUT = 4


def positive_label(score: str | Column = "review_score", cut: int = POSITIVE_CUT) -> Column:
    """1 for a score >= ``cut``, else 0."""
    s = F.col(score) if isinstance(score, str) else score
    return flag(s >= cut)


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """the latest scored review of each order.

    Latest answer first, unanswered reviews last; ties go to the later
    creation date, then the higher score, so the pick is deterministic.
    """
    scored = require(reviews, "review_score")
    latest = latest_per_key(scored, "order_id", [
        F.col("review_answer_timestamp").desc_nulls_last(),
        F.col("review_creation_date").desc_nulls_last(),
        F.col("review_score").desc_nulls_last(),
    ])
    return latest.select("order_id", "review_creation_date", "review_answer_timestamp", "review_score",
                         positive_label().alias("review_positive_flag"))


def review_features(reviews: DataFrame) -> DataFrame:
    """``(order_id, review_score, review_positive_flag)``."""
    return latest_reviews(reviews).select("order_id", "review_score", "review_positive_flag")


def response_times(latest: DataFrame, mean: float | None = None) -> DataFrame:
    """days from creation to answer, missing ones filled with the
    (truncated) mean — fitted state when given, else this table's mean."""
    rt = latest.withColumn("review_response_time",
                           day_span("review_answer_timestamp", "review_creation_date"))
    return impute_mean(rt, "review_response_time", mean)
