"""Running totals in value order without a global window.

``Window.orderBy(v)`` with no partition key moves every row into one task, and
``partitionBy(g)`` moves a group that holds a third of all rows into one.
Instead the rows (one per distinct value, so a value repeated by a third of
the table is already one row) are dealt into ranges of (groups, value) by Spark's range
partitioning, which orders any sortable type, nulls, NaN and infinities
included, as a sort would. The range numbers are written down once (a lost
executor re-reads them), totals per range and group give the offsets, and inside each
range a partitioned window adds the running total of its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.session import stage


def _first_row(values: Column, order_by: Column, descending: bool) -> Column:
    """Of the rows of one group: ``values`` of the first in order (a null comes last in descending, first in ascending order)."""
    null = F.max(F.when(order_by.isNull(), values))
    return F.coalesce(F.max_by(values, order_by), null) if descending else F.coalesce(null, F.min_by(values, order_by))


def running_totals(df: DataFrame, value: str, sums: list[str], descending: bool = True, rows_per_range: int = 1_000_000,
                   prefix: str = "cum_", groups: Sequence[str] = (), following: Sequence[str] = (), staged: bool = False) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows with value at or before this one.

    ``df`` must hold one row per distinct ``value`` (of a group; aggregate first). Also
    adds ``total_<c>`` = the sum of ``c`` over all rows. A null value comes
    last in descending and first in ascending order, NaN is the largest
    number. With ``groups`` both sums are taken per group (nulls are a group); a
    group may span any number of ranges. ``following`` adds ``next_<c>``, the column's value in the next row (of the
    group), null in the last. There are as many ranges as the session has shuffle partitions,
    and more when a range would hold over ``rows_per_range`` rows; only the
    offsets, one row per range and group, are ordered across ranges, and without groups they pass through one task.
    ``staged`` says that ``df`` is already a staged table, which is then not written again.
    """
    spark = df.sparkSession
    rows = df if staged else stage(df, "range_rows")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_range))
    order = F.col(value).desc() if descending else F.col(value).asc()
    ranged = stage(rows.repartitionByRange(ranges, *[F.col(g).asc() for g in groups], order).withColumn("_range", F.spark_partition_id()),
                   "ranges", rebalance=False)
    after = F.struct(*[F.col(c).alias(c) for c in following]) if following else None
    per_range = ranged.groupBy("_range", *groups).agg(*[F.sum(c).alias(f"_r_{c}") for c in sums],
                                                      *([_first_row(after, F.col(value), descending).alias("_first")] if following else []))
    own = Window.partitionBy(*groups)
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_range.select(
        F.col("_range").alias("_at"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)],
        *[F.coalesce(F.sum(f"_r_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_r_{c}").over(everything).alias(f"_total_{c}") for c in sums],
        *([F.lead("_first").over(own.orderBy("_range")).alias("_border")] if following else []),
    )
    match = F.col("_range") == F.col("_at")
    for k, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    in_order = Window.partitionBy("_range", *groups).orderBy(order)
    within = in_order.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(offsets, match).select(
        *df.columns,
        *[(F.sum(c).over(within) + F.col(f"_off_{c}")).alias(f"{prefix}{c}") for c in sums],
        *[F.col(f"_total_{c}").alias(f"total_{c}") for c in sums],
        *([F.coalesce(F.lead(after).over(in_order), F.col("_border")).alias("_next")] if following else []),
    )
    return out.select(*[c for c in out.columns if c != "_next"], *[F.col("_next")[c].alias(f"next_{c}") for c in following])
