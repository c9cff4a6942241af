"""Payment features per order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.expressions import (combine_fixed, complexity_bucket, contains_value, first_by, fixed_sum_merged,
                                             fixed_sum_parts, flag, installment_bucket)
from orderlens.operators.cleaning import filter_positive

# Payment types that get a membership flag, with the flag names.
PAYMENT_FLAGS = {
    "voucher": "in_voucher",
    "credit_card": "in_credit_card",
    "mobile": "in_mobile",
    "debit_card": "in_debit_card",
}

PAYMENT_FEATURES = ["order_id", "num_payment_types", "primary_payment_type", "multiple_payment_type_flag",
                    "num_payment_sequential", "total_payment_value", "max_installments",
                    "installment_category", "payment_complexity_category",
                    "in_credit_card", "in_voucher", "in_mobile"]


def payment_aggregates(payments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """per-order totals of the payments with at least one installment.

    Two levels: per (order, type) every buffer is numeric, so the first
    level is a hash aggregation over all payment rows (partial before its
    shuffle); the second level sees at most one row per type of an order and
    computes the distinct type count, the membership flags and the primary
    type (the non-null type of the lowest payment sequence number, ties to the
    smaller type), which makes the reference's order-dependent ``first``
    deterministic. Exact sums carry their parts across levels. ``keep`` names columns that are
    equal in all rows of an order and stay.
    """
    kept = filter_positive(payments, "payment_installments")
    sums = [f"_s{k}" for k in range(4)]
    per_type = kept.groupBy("order_id", *keep, "payment_type").agg(
        *[part.alias(name) for name, part in zip(sums, fixed_sum_parts("payment_value"))],
        F.min("payment_sequential").alias("_first_seq"),
        F.max("payment_sequential").alias("_last_seq"),
        F.max("payment_installments").alias("_max_inst"),
    )
    return per_type.groupBy("order_id", *keep).agg(
        F.round(combine_fixed(*fixed_sum_merged(sums)), 2).alias("total_payment_value"),
        F.count("payment_type").alias("num_payment_types"),
        F.max("_last_seq").alias("num_payment_sequential"),
        F.max("_max_inst").alias("max_installments"),
        first_by("payment_type", "_first_seq").alias("primary_payment_type"),
        *[contains_value("payment_type", v).alias(name) for v, name in PAYMENT_FLAGS.items()],
    )


def payment_features(payments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """F14-F16 on top of the aggregates, in the reference's column order."""
    return payment_labels(payment_aggregates(payments, keep), keep)


def payment_labels(aggregates: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """F14-F16 of given aggregates."""
    return aggregates.withColumns({
        "multiple_payment_type_flag": flag(F.col("num_payment_types") > 1),
        "installment_category": installment_bucket("max_installments"),
        "payment_complexity_category": complexity_bucket("num_payment_sequential"),
    }).select(*PAYMENT_FEATURES, *keep)
