"""Exact quantiles, of a whole column or of many groups at once.

One column: a mergeable sketch of the values brackets the wanted rank, and the next pass counts what lies below the
bracket and looks at the values inside it, with a new sketch while they are many, value by value once they are few. Nothing is
written, and the answer is the same whatever the sketch says: a bracket that misses the rank is widened to the side it missed.

Many groups: one count per distinct value of a group, and the running counts of ``running_totals`` name the value that
holds the rank, so a group with a third of all rows is spread over as many tasks as it needs.

NaN and infinities are ordinary values (NaN is the largest).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.operators.cumulative import running_totals

#: Size parameter of the bracketing sketch, and the half width of a bracket: over twice the sketch's rank error.
SKETCH_K, HALF_WIDTH = 4096, 0.003


def _rank(p: float, n: int) -> int:
    return min(max(math.ceil(p * n), 1), n)


def exact_quantiles(df: DataFrame, col: str, ps: list[float], rows_per_range: int = 1_000_000) -> list[float]:
    """For each ``p`` the smallest value whose cumulative share of non-null rows is >= ``p``; equals
    ``percentile_disc(p)`` and ``approxQuantile(col, [p], 0.0)``. At most ``rows_per_range`` rows, and never more than
    100,000, are looked at value by value. A column without values is an error."""
    if not all(0.0 <= p <= 1.0 for p in ps):
        raise ValueError("p must be in [0, 1]")
    values = df.select(F.col(col).cast("double").alias("x")).where("x is not null").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        x = F.col("x")
        whole = values.agg(F.count(x).alias("n"), F.count_if(~F.isnan(x)).alias("numbers"),
                           F.kll_sketch_agg_double(x, F.lit(SKETCH_K)).alias("sketch")).first()
        if not whole["n"]:
            raise ValueError(f"no non-null values in {col!r} to take a quantile of")
        return [_select(values, _rank(p, whole["n"]), whole["numbers"], whole["sketch"], min(rows_per_range, 100_000)) for p in ps]
    finally:
        values.unpersist()


def _bracket(values: DataFrame, sketch: bytearray, rank: int, n: int) -> tuple[float, float]:
    """The sketch's values a little below and above the rank."""
    shares = [min(1.0, max(0.0, rank / n + d)) for d in (-HALF_WIDTH, HALF_WIDTH)]
    at = [F.kll_sketch_get_quantile_double(F.lit(bytes(sketch)), F.lit(s)).alias(name) for s, name in zip(shares, ("lo", "hi"))]
    return tuple(values.sparkSession.range(1).select(*at).first())


def _select(values: DataFrame, rank: int, n: int, sketch: bytearray, most: int) -> float:
    """The value of the wanted rank among the ``n`` numbers, by ever narrower brackets."""
    if rank > n:
        return math.nan                                     # NaN comes after all numbers
    numbers, x = values.where(~F.isnan("x")), F.col("x")
    (lo, hi), least, greatest, below = _bracket(values, sketch, rank, n), -math.inf, math.inf, 0    # for certain: least <= value <= greatest
    while True:
        if n * 4 * HALF_WIDTH <= most or n <= most:         # few values in the bracket: one by one, those below as one
            found = numbers.where(x <= F.lit(hi)).groupBy(F.when(x >= F.lit(lo), x).alias("x")).count().limit(most + 2).collect()
            if len(found) < most + 2:
                seen = sum(r["count"] for r in found if r["x"] is None)
                if seen < rank:
                    for value, times in sorted((r["x"], r["count"]) for r in found if r["x"] is not None):
                        seen += times
                        if seen >= rank:
                            return float(value)
                    lo, hi = math.nextafter(hi, math.inf), greatest     # missed: above the bracket
                else:
                    lo, hi = least, math.nextafter(lo, -math.inf)       # missed: below it
                continue
        inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
        got = numbers.agg(F.count_if(x < F.lit(lo)).alias("below"), F.count_if(inside).alias("n"),
                          F.kll_sketch_agg_double(F.when(inside, x), F.lit(SKETCH_K)).alias("sketch")).first()
        if rank <= got["below"]:
            lo, hi = least, math.nextafter(lo, -math.inf)
        elif rank > got["below"] + got["n"]:
            lo, hi = math.nextafter(hi, math.inf), greatest
        elif lo == hi:
            return float(lo)
        else:
            least, greatest, below, n = lo, hi, got["below"], got["n"]
            lo, hi = _bracket(values, got["sketch"], rank - below, n)


def quantile_row(df: DataFrame, col: str, ps: list[float], rows_per_range: int = 1_000_000) -> DataFrame:
    """``exact_quantiles`` as one row ``q0, q1, ...`` (nulls without any value)."""
    try:
        found = exact_quantiles(df, col, ps, rows_per_range)
    except ValueError as e:
        if "no non-null values" not in str(e):
            raise
        found = [None] * len(ps)
    return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"q{i} double" for i in range(len(ps))))


def exact_quantile(df: DataFrame, col: str, p: float, rows_per_range: int = 1_000_000) -> float:
    """A single quantile; see ``exact_quantiles``."""
    return exact_quantiles(df, col, [p], rows_per_range)[0]


def grouped_quantiles(df: DataFrame, groups: Sequence[str], col: str, ps: list[float], rows_per_range: int = 1_000_000) -> DataFrame:
    """The groups (nulls are one) with ``q0, q1, ...``, the exact quantiles of each; groups without a value are left out."""
    counts = df.select(*groups, F.col(col).cast("double").alias("_x")).where("_x is not null") \
        .groupBy(*groups, "_x").agg(F.count(F.lit(1)).alias("_n"))
    curve = running_totals(counts, "_x", ["_n"], descending=False, rows_per_range=rows_per_range, groups=groups)

    def at(p: float) -> Column:
        total = F.col("total__n")
        rank = F.least(F.greatest(F.ceil(F.lit(float(p)) * total), F.lit(1)), total)
        return F.max(F.when((F.col("cum__n") >= rank) & (F.col("cum__n") - F.col("_n") < rank), F.col("_x")))

    return curve.groupBy(*groups).agg(*[at(p).alias(f"q{i}") for i, p in enumerate(ps)])
