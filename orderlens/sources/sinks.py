"""Writing predictions and previewing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def write_predictions(df: DataFrame, path: str, key: str = "order_id",
                      prediction: str = "prediction", fmt: str = "parquet") -> None:
    """Write the ``(key, prediction)`` table; overwrite makes a retried job idempotent."""
    df.select(key, prediction).write.mode("overwrite").format(fmt).save(path)


def preview(df: DataFrame, n: int = 5, order_by: list[str | Column] | None = None) -> DataFrame:
    """First ``n`` rows in a fixed order (a bare ``limit`` depends on partitioning).

    With an order this plans as TakeOrderedAndProject: each task keeps its
    own top ``n`` and only ``n`` rows per task reach the final merge.
    """
    keys = order_by if order_by is not None else df.columns
    return df.orderBy(*keys).limit(n)
