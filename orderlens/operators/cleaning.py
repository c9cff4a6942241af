"""Row filters, dedupe and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.sources.tables import NA


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows where every column is null."""
    return df.na.drop(how="all")


def drop_sentinel(df: DataFrame, col: str, sentinel: str = NA) -> DataFrame:
    """Drop rows whose key is null or equals the sentinel text.

    Only a text column can hold the sentinel; on other key types the filter
    reduces to ``IS NOT NULL`` (comparing a number to ``'NA'`` would fail
    under ANSI casts).
    """
    if isinstance(df.schema[col].dataType, T.StringType):
        return df.filter(F.col(col) != F.lit(sentinel))
    return df.filter(F.col(col).isNotNull())


def filter_status(df: DataFrame, col: str, value: str) -> DataFrame:
    """Keep rows with ``col == value`` (pushed to the scan)."""
    return df.filter(F.col(col) == F.lit(value))


def filter_positive(df: DataFrame, col: str) -> DataFrame:
    """C4: keep rows with ``col > 0``."""
    return df.filter(F.col(col) > 0)


def require(df: DataFrame, col: str) -> DataFrame:
    """Keep rows where ``col`` is present."""
    return df.filter(F.col(col).isNotNull())


def dedupe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop exact duplicate rows (or duplicates on ``cols``)."""
    return df.dropDuplicates(cols) if cols else df.dropDuplicates()


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with any null (in ``cols``)."""
    return df.na.drop(how="any", subset=cols)


def column_mean(df: DataFrame, col: str) -> float:
    """Global mean of ``col`` as a number (the fitted state of C8).

    A null mean (no non-null values) is an error: there is nothing to impute.
    """
    value = df.agg(F.avg(F.col(col)).alias("m")).first()["m"]
    if value is None:
        raise ValueError(f"cannot impute {col!r}: it has no non-null values")
    return float(value)


def impute_mean(df: DataFrame, col: str, mean: float | Column | None = None) -> DataFrame:
    """Fill nulls in ``col`` with its mean, cast to the column's type.

    An integer column takes the truncated mean (2.9 -> 2). Without a fitted
    ``mean`` the global mean runs as a scalar subquery inside the same plan.
    """
    dtype = df.schema[col].dataType
    if mean is None:
        mean = df.agg(F.avg(F.col(col))).scalar()
    fill = mean if isinstance(mean, Column) else F.lit(float(mean))
    return df.withColumn(col, F.coalesce(F.col(col), fill.cast(dtype)))
