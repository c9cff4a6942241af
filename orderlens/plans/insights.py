"""Summaries over the feature tables: the delivery slice and R6 outcome tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.operators.quantile import grouped_quantiles
from orderlens.session import stage


def season_delivery_summary(order_f: DataFrame) -> DataFrame:
    """Delivered orders per purchase season: count, late share, mean delay."""
    return (order_f.groupBy("purchase_season")
            .agg(F.count(F.lit(1)).alias("orders"),
                 F.avg("late_delivery_flag").alias("late_rate"),
                 F.avg("delivery_delay").alias("avg_delay_days"))
            .orderBy("purchase_season"))


def outcome_by(df: DataFrame, key: str, label: str = "review_positive_flag") -> DataFrame:
    """Rows and positive-outcome share per value of ``key``."""
    return (df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("orders"), F.avg(F.col(label).cast("double")).alias("positive_rate"))
            .orderBy(key))


def _entropy(positive: Column, rows: Column) -> Column:
    """Bits of a yes/no outcome with so many positives; 0 where it is certain."""
    p = positive / rows
    return F.when((positive > 0) & (positive < rows), -(p * F.log2(p)) - (1 - p) * F.log2(1 - p)).otherwise(0.0)


def rank_factors(df: DataFrame, label: str = "review_positive_flag", exclude: tuple[str, ...] = ("order_id",), bins: int = 10) -> DataFrame:
    """``factor, levels, orders, information_gain, rank``: how much each column tells about a 0/1 outcome, in bits.

    Numbers are cut at their quantiles (all columns at once, by ranges of (column, value)), text is taken as it is, a null is a
    level. One pass turns every row into its (column, level) pairs, and one aggregation counts rows and positives of each. The
    gain is rounded to 9 decimals; equal ones are ranked by name.
    """
    skip = {label, *exclude}
    fields = [f for f in df.schema.fields if f.name not in skip]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in fields if f.name not in text]
    df = stage(df, "factors")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "factor", "x")
    shares = [k / bins for k in range(1, bins)]
    edges = {r["factor"]: sorted(set(r[1:])) for r in grouped_quantiles(long, ["factor"], "x", shares).collect()}     # one row per column

    def level(c: str) -> Column:
        if c in text:
            return F.col(c)
        x = F.col(c).cast("double")
        above = reduce(lambda a, b: a + b, [(x > e).cast("int") for e in edges.get(c, [])], F.lit(0))
        return F.when(x.isNotNull(), above.cast("string"))

    pairs = df.select(F.col(label).cast("long").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("factor"), level(f.name).alias("level")) for f in fields])).alias("p")).select("y", "p.*")
    cells = pairs.groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    rest = F.sum(F.col("n") * _entropy(F.col("pos"), F.col("n")))
    gains = cells.groupBy("factor").agg(F.count(F.lit(1)).alias("levels"), F.sum("n").alias("orders"), F.sum("pos").alias("pos"), rest.alias("rest"))
    gain = F.round(F.greatest(F.lit(0.0), _entropy(F.col("pos"), F.col("orders")) - F.col("rest") / F.col("orders")), 9)
    return gains.select("factor", "levels", "orders", gain.alias("information_gain")) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("information_gain").desc(), "factor")))
