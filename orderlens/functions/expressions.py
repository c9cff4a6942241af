"""Column expressions shared by the feature builders.

Everything here returns a built-in ``Column`` expression, so it stays inside
whole-stage codegen; nothing calls back into Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season of each purchase month; months not listed are "Fall"
# (and so is a missing month).
SEASON_MONTHS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
}
SEASON_DEFAULT = "Fall"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """0/1 integer flag; a null condition counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def case_labels(branches: Sequence[tuple[Column, str]], default: str) -> Column:
    """First matching branch wins; a null test falls through to ``default``."""
    expr = None
    for cond, label in branches:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def season(month: str | Column) -> Column:
    m = _col(month)
    return case_labels([(m.isin(*months), name) for name, months in SEASON_MONTHS.items()],
                       SEASON_DEFAULT)


def day_span(end: str | Column, start: str | Column) -> Column:
    """Calendar days from ``start`` to ``end``; time of day is ignored."""
    return F.datediff(_col(end), _col(start))


# Upper edges (inclusive) and labels of the buckets; the last label takes the rest and nulls.
PHOTO_BUCKETS = ((2, 5), ("Low", "Medium", "High"))
INSTALLMENT_BUCKETS = ((1, 3), ("One-Time", "Short-Term", "Long-Term"))
COMPLEXITY_BUCKETS = ((1, 3), ("Simple", "Moderate", "Complex"))


def bucketize(c: str | Column, edges: Sequence[float], labels: Sequence[str], least: float | None = None) -> Column:
    """The label of the first edge that the value does not exceed, else (null too) the last label.

    Values below ``least`` also get the last label.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("one label per edge and one for the rest")
    x = _col(c)
    known = F.lit(True) if least is None else x >= least
    return case_labels([(known & (x <= edge), label) for edge, label in zip(edges, labels)], labels[-1])


def photo_bucket(avg_photos: str | Column) -> Column:
    return bucketize(avg_photos, *PHOTO_BUCKETS)


def installment_bucket(max_installments: str | Column) -> Column:
    """Counts start at 1: anything lower is no known plan."""
    return bucketize(max_installments, *INSTALLMENT_BUCKETS, least=1)


def complexity_bucket(max_sequential: str | Column) -> Column:
    return bucketize(max_sequential, *COMPLEXITY_BUCKETS, least=1)


def fixed_sum_parts(c: str | Column) -> list[Column]:
    """The partial sums behind ``fixed_sum``: whole parts, seven and then eight decimals after the point, as ``bigint``s, and
    the values that are no finite numbers, as a double. Partial sums of groups add up
    (``fixed_sum_merged``), so a two-level aggregation stays exact."""
    x = _col(c).cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    whole = F.floor(finite)
    high = (finite - whole) * F.lit(1e7)
    low = F.rint((high - F.floor(high)) * F.lit(1e8)).cast("long")
    return [F.sum(whole), F.sum(F.floor(high)), F.sum(low), F.sum(F.when(finite.isNull(), x))]


def fixed_sum_merged(parts: Sequence[str]) -> list[Column]:
    """The partial sums of a group of partial sums, by the columns that hold them."""
    return [F.sum(p) for p in parts]


def combine_fixed(whole: Column, high: Column, low: Column, special: Column) -> Column:
    """The double nearest to the total of the parts; NaN or an infinity when a value is one."""
    def units(c: Column, unit: str, scale: int) -> Column:
        return c.cast("decimal(20,0)") * F.lit(unit).cast(f"decimal({scale},{scale})")

    total = (whole.cast("decimal(20,0)") + units(high, "1e-7", 7)).cast("decimal(30,7)") + units(low, "1e-15", 15)
    return F.coalesce(special, total.cast("double"))


def fixed_sum(c: str | Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows, returned as the nearest double.

    Each value splits into its whole part and 15 decimals after the point, which are summed as ``bigint``s
    (hash-aggregate friendly and independent of partitioning and merge order, which a ``double`` sum is
    not); a value is off by 5e-16 at most, which is less than a double of 8 or more can tell. Whole parts overflow (an
    error, never a wrong sum) past 9.2e18 in value and decimals past 9e10 rows per group. NaN and infinities
    give what a sum of doubles gives.
    """
    return combine_fixed(*fixed_sum_parts(c))


def first_by(value: str | Column, order: str | Column) -> Column:
    """Value at the lowest ``order`` among rows whose value is not null.

    A deterministic ``first(value, ignorenulls=True)``: ties on ``order`` go
    to the smaller value.
    """
    v = _col(value)
    picked = F.min(F.when(v.isNotNull(), F.struct(_col(order).alias("o"), v.alias("v"))))
    return picked.getField("v")


def contains_value(c: str | Column, value) -> Column:
    """1 when any row of the group has ``c == value``, else 0 (``bool_or`` as int)."""
    return F.max(flag(_col(c) == F.lit(value)))


def count_where(cond: Column) -> Column:
    return F.count_if(cond)
