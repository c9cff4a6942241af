"""The five order tables, derived from the driver's Parquet test tables.

The test data is a TPC-H-like star schema without nulls. These views give it
the shape of the order tables (FIXTURES.md) and inject missing values with
CASE rules so that every null rule of the feature builders is exercised.
Keys stay ``bigint``: the builders are agnostic to the key type, and 8-byte
keys hash and compare faster than text ids.

The CASE rules (e.g. a null category when ``p_partkey % 17 = 0``) only set values
to null or map a status; no rule filters or drops a row, so every query built
on these views reads the whole tables.

The oracle SQL (``orderlens.oracle``) defines the same views in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _plus_days(ts, days):
    return ts + F.make_dt_interval(days=days.cast("int"))


def _money(c):
    return F.col(c).cast("decimal(12,2)")


def products_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 17 != 0, F.col("p_type")).alias("product_category_name"),
        F.when(size != 13, size % 8).cast("int").alias("product_photos_qty"),
        F.col("p_retailprice").alias("product_weight_g"),
        size.cast("double").alias("product_length_cm"),
        (size % 7 + 1).cast("double").alias("product_height_cm"),
        (size % 5 + 1).cast("double").alias("product_width_cm"),
    )


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    purchase = F.col("o_orderdate")
    approved = _plus_days(purchase, k % 3)
    carrier = _plus_days(approved, k % 5)
    return o.select(
        k.alias("order_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("delivered"))
         .otherwise(F.col("o_orderstatus")).alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        approved.alias("order_approved_at"),
        carrier.alias("order_delivered_carrier_date"),
        F.when(k % 50 != 0, _plus_days(carrier, F.col("o_custkey") % 40))
         .alias("order_delivered_customer_date"),
        _plus_days(purchase, 20 + k % 11).alias("order_estimated_delivery_date"),
    )


def order_items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").alias("price"),
        (_money("l_extendedprice") * _money("l_tax")).cast("double").alias("shipping_cost"),
    )


def order_payments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    ptype = (F.when(F.col("l_quantity") > 45, F.lit("mobile"))
             .when(flag == "A", F.lit("credit_card"))
             .when(flag == "N", F.lit("voucher"))
             .when(flag == "R", F.lit("debit_card")))
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        ptype.alias("payment_type"),
        (F.col("l_quantity").cast("int") % 6).alias("payment_installments"),
        F.col("l_extendedprice").alias("payment_value"),
    )


def order_reviews_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        (eid / 2).cast("long").alias("order_id"),
        (F.floor(F.col("value")) % 5 + 1).cast("int").alias("review_score"),
        F.col("ts").alias("review_creation_date"),
        F.when(eid % 10 != 0, _plus_days(F.col("ts"), eid % 7)).alias("review_answer_timestamp"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score, prediction) pairs for the evaluation operators."""
    ev = _read(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("row_id"),
        (F.col("event_type") == "purchase").cast("double").alias("label"),
        F.col("value").alias("score"),
        (F.col("value") > 50).cast("double").alias("prediction"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, prediction) pairs from the labels table: quality vs toxic."""
    lb = _read(spark, sf_dir, "labels")
    return lb.select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("double").alias("label"),
        F.col("toxic").cast("double").alias("prediction"),
    )


def order_tables(spark: SparkSession, sf_dir: str, with_reviews: bool = True) -> dict[str, DataFrame]:
    """All five views, keyed like ``load_sources``."""
    out = {
        "products": products_view(spark, sf_dir),
        "orders": orders_view(spark, sf_dir),
        "order_items": order_items_view(spark, sf_dir),
        "order_payments": order_payments_view(spark, sf_dir),
    }
    if with_reviews:
        out["order_reviews"] = order_reviews_view(spark, sf_dir)
    return out
