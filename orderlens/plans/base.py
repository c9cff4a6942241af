"""One base row per order, and the fit/apply entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators.cleaning import drop_incomplete
from orderlens.plans.items import ITEM_FEATURES, item_aggregates, item_features
from orderlens.plans.orders import order_features
from orderlens.plans.payments import PAYMENT_FEATURES, payment_features
from orderlens.plans.products import product_features
from orderlens.plans.reviews import review_features
from orderlens.plans.state import FeatureState

LABEL = "review_positive_flag"
KEY = "order_id"

ORDER_COLUMNS = ["order_id", "approval_time", "carrier_delivery_time", "customer_delivery_time",
                 "delivery_delay", "late_delivery_flag", "delivery_days"]
BASE_COLUMNS = ORDER_COLUMNS + PAYMENT_FEATURES[1:] + ITEM_FEATURES[1:]


def base_table(orders_f: DataFrame, payments_f: DataFrame, items_f: DataFrame,
               reviews_f: DataFrame | None = None, complete_only: bool = True,
               with_year_category: bool = False) -> DataFrame:
    """Orders with their payment, item and (training only) review features.

    Every feature table except the orders is unique per ``order_id`` by
    construction (an aggregate or a top-1 window) and arrives hash-partitioned
    on ``order_id``, so the joins add no shuffle on those sides. Exact
    duplicates of the joined row can only come from duplicate order rows; they
    are removed on the narrow order side before the joins, where the dedupe
    collapses copies map-side, so even a group of copies holding a third of
    all rows is reduced before its shuffle.

    With ``complete_only`` (the reference's final any-null drop) the payment
    join is written as an inner join, which that drop makes it equivalent to.
    ``with_year_category`` keeps ``purchase_year_cat`` (F23), which the
    reference computes and then drops.
    """
    keep = ORDER_COLUMNS + (["purchase_year"] if with_year_category else [])
    orders = orders_f.select(*keep)
    if with_year_category:
        orders = orders.withColumn("purchase_year_cat", F.col("purchase_year").cast("string")) \
                       .drop("purchase_year")
    orders = orders.dropDuplicates()
    joined = orders
    if reviews_f is not None:
        joined = joined.join(reviews_f.select(KEY, LABEL), KEY, "inner")
    joined = (joined.join(items_f, KEY, "inner")
                    .join(payments_f, KEY, "inner" if complete_only else "left"))
    cols = BASE_COLUMNS + (["purchase_year_cat"] if with_year_category else []) \
        + ([LABEL] if reviews_f is not None else [])
    out = joined.select(*cols)
    return drop_incomplete(out) if complete_only else out


def build_base(tables: dict[str, DataFrame], state: FeatureState, complete_only: bool = True,
               item_aggs: DataFrame | None = None) -> DataFrame:
    """Feature builders + base table for one set of tables, with fitted state.

    Training tables carry ``order_reviews`` (the label); holdout tables
    don't, and get the same columns minus the label. ``item_aggs`` reuses
    already computed (cached) per-order item aggregates.
    """
    if item_aggs is None:
        item_aggs = item_aggregates(tables["order_items"], product_features(tables["products"]))
    items_f = item_features(item_aggs, state.shipping_threshold)
    reviews_f = review_features(tables["order_reviews"]) if "order_reviews" in tables else None
    return base_table(order_features(tables["orders"]), payment_features(tables["order_payments"]),
                      items_f, reviews_f, complete_only=complete_only)
