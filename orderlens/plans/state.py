"""Fitted feature state: values learned on the training tables and reused
unchanged on holdout tables (one fit/apply path instead of refitting)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from orderlens.functions.expressions import day_span
from orderlens.operators.cleaning import column_mean
from orderlens.plans.items import SHIPPING_QUANTILE, fit_shipping_threshold, item_aggregates
from orderlens.plans.products import product_features
from orderlens.plans.reviews import latest_reviews


@dataclass(frozen=True)
class FeatureState:
    shipping_threshold: float
    shipping_quantile: float = SHIPPING_QUANTILE
    response_time_mean: float | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "FeatureState":
        return cls(**json.loads(text))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "state string").coalesce(1) \
             .write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureState":
        return cls.from_json(spark.read.text(path).first()[0])


def fit_feature_state(tables: dict[str, DataFrame], quantile: float = SHIPPING_QUANTILE,
                      rel_err: float = 0.0, item_aggs: DataFrame | None = None,
                      response_mean: bool = True) -> FeatureState:
    """Fit the shipping threshold (and, with ``response_mean`` and reviews
    present, the response-time mean used by ``response_times``; the base
    table does not use it, so the training path skips that job).

    Pass ``item_aggs`` when the caller has already cached the per-order item
    aggregates; otherwise only their shipping column is cached here for the
    quantile passes.
    """
    own = item_aggs is None
    if own:
        item_aggs = item_aggregates(tables["order_items"], product_features(tables["products"]))
    shipping = item_aggs.select("total_shipping_cost")
    if own:
        shipping = shipping.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        thr = fit_shipping_threshold(shipping, quantile, rel_err)
    finally:
        if own:
            shipping.unpersist()
    mean = None
    if response_mean and "order_reviews" in tables:
        observed = latest_reviews(tables["order_reviews"]).select(
            day_span("review_answer_timestamp", "review_creation_date").alias("review_response_time"))
        mean = column_mean(observed, "review_response_time")
    return FeatureState(shipping_threshold=thr, shipping_quantile=quantile, response_time_mean=mean)
