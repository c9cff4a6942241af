"""A10: approximate quantiles with a rank-error bound, as state that grows with every new batch.

The state is one mergeable sketch (KLL, a few kilobytes whatever the number of values). A new batch is summarised by
itself, with partial sketches per task, and merged into the state; the old rows are never read again.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the relative rank error that the reference's quantile allows.
RANK_ERROR = 0.05


@dataclass(frozen=True)
class QuantileSketch:
    """A sketch of the numbers of one column; ``n`` counts them, ``k`` sets its size and with it its error."""

    data: str = ""
    n: int = 0
    k: int = 800

    @classmethod
    def of(cls, df: DataFrame, col: str, k: int = 800) -> "QuantileSketch":
        """Of a column's values in one pass; nulls and NaN have no rank and are left out."""
        x = F.col(col).cast("double")
        row = df.agg(F.kll_sketch_agg_double(F.when(~F.isnan(x), x), F.lit(k)).alias("s")).select(
            "s", F.kll_sketch_get_n_double("s").alias("n")).first()
        return cls(base64.b64encode(bytes(row["s"])).decode(), row["n"], k) if row["n"] else cls(k=k)

    def merged(self, spark: SparkSession, other: "QuantileSketch") -> "QuantileSketch":
        """The sketch of both sets of values."""
        if not self.n or not other.n:
            return self if self.n else other
        both = spark.range(1).select(F.kll_sketch_merge_double(self._lit(), other._lit()).alias("s")).first()["s"]
        return QuantileSketch(base64.b64encode(bytes(both)).decode(), self.n + other.n, self.k)

    def add(self, batch: DataFrame, col: str) -> "QuantileSketch":
        """The state after a new batch, which alone is read."""
        return self.merged(batch.sparkSession, QuantileSketch.of(batch, col, self.k))

    def quantile(self, spark: SparkSession, p: float) -> float:
        """A value whose rank is within the sketch's error of ``p`` (with k = 800 about 0.006 with 99 % confidence)."""
        if not self.n:
            raise ValueError("no values to take a quantile of")
        return float(spark.range(1).select(F.kll_sketch_get_quantile_double(self._lit(), F.lit(float(p)))).first()[0])

    def _lit(self):
        return F.lit(base64.b64decode(self.data))


def rank_check(df: DataFrame, col: str, answers: dict[float, float], error: float = RANK_ERROR) -> DataFrame:
    """``p, n, least_rank, greatest_rank, within_bound``: whether each answer holds a rank within ``error`` of ``p`` (a value
    that occurs more than once holds a range of ranks), by counting over the whole column."""
    x = F.col(col).cast("double")
    known = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    counts = [F.struct(F.lit(p).alias("p"), F.count_if(F.col("x") < v).alias("below"), F.count_if(F.col("x") <= v).alias("upto"),
                       F.count(F.lit(1)).alias("n")) for p, v in answers.items()]
    rows = known.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    least, greatest = F.floor((F.col("p") - error) * F.col("n")).cast("long"), F.ceil((F.col("p") + error) * F.col("n")).cast("long")
    return rows.select("p", "n", least.alias("least_rank"), greatest.alias("greatest_rank"),
                       ((F.col("upto") >= least) & (F.col("below") + 1 <= greatest)).alias("within_bound"))
