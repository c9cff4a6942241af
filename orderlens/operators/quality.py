"""Profiling and data-quality summaries, each one aggregation job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def describe_table(df: DataFrame, cols: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Count, mean, stddev, min, max per numeric column, in long form.

    One pass with partial aggregation for all columns together; the one-row
    result becomes ``(column_name, count, mean, stddev, min, max, min_exact, max_exact)``. All minima are taken
    in the column's own type: ``min`` and ``max`` show them as doubles, ``min_exact`` and ``max_exact`` those of integers and
    decimals as text, so that a key above 2**53 keeps every digit and a decimal its scale (null for floating columns, which need none).
    ``digits`` rounds mean and stddev (floating sums differ in the last bits
    between merge orders).
    """
    cols = cols or numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, count long, mean double, stddev double, min double, max double, min_exact string, max_exact string")

    def floating(name):
        return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))

    def rounded(c):
        return c if digits is None else F.round(c, digits)

    rows = []
    for name in cols:
        own = F.col(f"`{name}`")
        x = own.cast("double")
        rows.append(F.struct(F.lit(name).alias("column_name"), F.count(own).alias("count"), rounded(F.avg(x)).alias("mean"),
                             rounded(F.stddev_samp(x)).alias("stddev"), F.min(own).cast("double").alias("min"), F.max(own).cast("double").alias("max"),
                             *[(F.lit(None) if floating(name) else f(own)).cast("string").alias(f"{n}_exact") for n, f in (("min", F.min), ("max", F.max))]))
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def describe_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P1 for text columns: ``(column_name, count, min, max)``, count, least and greatest value of each.

    One pass; a table without text columns gives no rows.
    """
    cols = text_columns(df) if cols is None else cols
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, count long, min string, max string")
    wide = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))])
    rows = ", ".join(f"'{c}', n{i}, lo{i}, hi{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {rows}) as (column_name, count, min, max)")


def null_counts(df: DataFrame) -> DataFrame:
    """One row, one ``bigint`` null count per column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def null_counts_long(df: DataFrame) -> DataFrame:
    """``(null_count, column_name)`` rows."""
    wide = null_counts(df)
    return wide.unpivot([], wide.columns, "column_name", "null_count").select("null_count", "column_name")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, ordered by value (nulls first, as ``orderBy``)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(col)


def row_counts(dfs: dict[str, DataFrame]) -> DataFrame:
    """P5: ``(table_name, row_count)`` for several tables in one plan."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in dfs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_count(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows minus distinct rows, in one job (groups of copies partially
    aggregated before the shuffle, so a hot duplicate does not pile up)."""
    cols = cols or df.columns
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
            .agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicate_count")))


def column_info(df: DataFrame) -> DataFrame:
    """Column position, name and type (metadata only, no job)."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string")
