"""Top row per key and top-k rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under ``order`` (``row_number() == 1``).

    Catalyst plans this with a partial WindowGroupLimit before the shuffle,
    so each map task forwards at most one row per key: a key holding a third
    of all rows reaches its reducer as one row per map task.
    Put enough tie-breakers in ``order`` to make the pick deterministic.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """O3: the ``k`` first rows under ``order`` (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)
