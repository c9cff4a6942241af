"""F7-F11 with J1: item features per order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.expressions import fixed_sum, flag, photo_bucket
from orderlens.operators.quantile import exact_quantile

ITEM_FEATURES = ["order_id", "total_items", "total_price", "total_shipping_cost", "order_weight",
                 "order_size", "num_distinct_products_category", "average_item_price",
                 "high_shipping_cost_flag", "photo_per_order_category"]

#: Totals are reported to so many decimals: more than prices, weights and volumes have, fewer than doubles get wrong.
DECIMALS = 6

# Fixed values of the shipping rule: the 90th percentile of the order totals.
SHIPPING_QUANTILE = 0.9


def item_aggregates(items: DataFrame, product_f: DataFrame) -> DataFrame:
    """F7/F8 + J1: items joined to their product, summed per order.

    The join carries no hint: AQE broadcasts the product side when its
    measured size allows it and otherwise splits a hot product's partition. The per-order
    aggregate is partially computed before its shuffle, and its output stays
    hash-partitioned on ``order_id`` for the base-table join. Sums are exact
    and rounded as a whole, so totals do not depend on partitioning.
    """
    joined = items.join(product_f, "product_id")
    agg = joined.groupBy("order_id").agg(
        F.count("order_item_id").alias("total_items"),
        F.round(fixed_sum("price"), DECIMALS).alias("total_price"),
        F.round(fixed_sum("shipping_cost"), DECIMALS).alias("total_shipping_cost"),
        F.round(fixed_sum("product_weight_kg"), DECIMALS).alias("order_weight"),
        F.round(fixed_sum("product_vol_cm3"), DECIMALS).alias("order_size"),
        F.count_distinct("product_category_name").alias("num_distinct_products_category"),
        F.avg("product_photos_qty").alias("avg_photo_per_order"),
    )
    return agg.withColumn("average_item_price", F.try_divide(F.col("total_price"), F.col("total_items")))


def fit_shipping_threshold(aggregates: DataFrame, p: float = SHIPPING_QUANTILE,
                           rel_err: float = 0.0) -> float:
    """the ``p`` quantile of the per-order shipping totals.

    ``rel_err == 0`` gives the exact (``percentile_disc``) value through the
    distributed rank search; ``rel_err > 0`` uses Spark's bounded
    ``approxQuantile`` sketch with that relative error.
    """
    if rel_err > 0:
        res = aggregates.approxQuantile("total_shipping_cost", [p], rel_err)
        if not res:
            raise ValueError("no shipping totals to take a quantile of")
        return float(res[0])
    return exact_quantile(aggregates, "total_shipping_cost", p)


def item_features(aggregates: DataFrame, shipping_threshold: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """high-shipping flag against the fitted threshold, photo bucket (and the ``keep`` columns as they are)."""
    return aggregates.select(
        *ITEM_FEATURES[:-2],
        flag(F.col("total_shipping_cost") > F.lit(float(shipping_threshold))).alias("high_shipping_cost_flag"),
        photo_bucket("avg_photo_per_order").alias("photo_per_order_category"), *keep,
    )
