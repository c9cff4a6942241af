"""Order features (delivery intervals, late flag, calendar, season)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.expressions import day_span, flag, season
from orderlens.operators.cleaning import drop_sentinel, filter_status

# Fixed value: the only order status that is kept.
DELIVERED = "delivered"

ORDER_FEATURES = ["order_id", "approval_time", "carrier_delivery_time", "customer_delivery_time",
                  "delivery_delay", "late_delivery_flag", "delivery_days",
                  "purchase_month", "purchase_year", "purchase_season"]


def delivery_intervals(orders: DataFrame) -> dict:
    """day intervals between the five order dates."""
    return {
        "approval_time": day_span("order_approved_at", "order_purchase_timestamp"),
        "carrier_delivery_time": day_span("order_delivered_carrier_date", "order_approved_at"),
        "customer_delivery_time": day_span("order_delivered_customer_date", "order_delivered_carrier_date"),
        "delivery_delay": day_span("order_delivered_customer_date", "order_estimated_delivery_date"),
        "delivery_days": day_span("order_delivered_customer_date", "order_purchase_timestamp"),
    }


def late_flag(delay_col: str = "delivery_delay"):
    """1 when delivered after the estimate; unknown delay counts as 0."""
    return flag(F.col(delay_col) > 0)


def calendar_parts(ts_col: str = "order_purchase_timestamp") -> dict:
    """purchase month and year."""
    return {"purchase_month": F.month(ts_col), "purchase_year": F.year(ts_col)}


def order_features(orders: DataFrame, status: str = DELIVERED, keep: tuple[str, ...] = ()) -> DataFrame:
    """one projection over the delivered orders with a usable id (and the ``keep`` columns as they are)."""
    kept = filter_status(drop_sentinel(orders, "order_id"), "order_status", status)
    cols = {**delivery_intervals(kept), **calendar_parts()}
    out = kept.select("order_id", *[v.alias(k) for k, v in cols.items()], *keep)
    return out.withColumns({"late_delivery_flag": late_flag(), "purchase_season": season("purchase_month")}).select(*ORDER_FEATURES, *keep)
