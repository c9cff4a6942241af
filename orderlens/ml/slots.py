"""M1 as a relational plan: the feature slots of the formula by joins, without a level on the driver.

The levels of every text column are ranked by frequency in a staged dictionary table. A row finds its level's rank by a
join per text column; each row then gets its filled slots, as numbers and values. The least frequent level of a column
has no slot (the reference level); an unseen level or a null joins nothing and so counts as it. Slots are numbered as
the formula numbers them: columns in order, a text column taking one slot less than it has levels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.operators.cumulative import running_totals
from orderlens.session import stage


@dataclass
class SlotModel:
    """``columns``: (name, first slot, levels or 0 for a number); ``levels``: column_name, level, rank (from 0); ``size`` slots."""

    columns: list[tuple[str, int, int]]
    levels: DataFrame
    size: int


def level_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, level, n, rank``: the levels of text columns by descending frequency, equal ones in alphabetical order.

    Counts are partial before the shuffle; the order over the distinct levels is dealt over ranges, however many a column has.
    """
    counts = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "level") \
        .where("level is not null").groupBy("column_name", "level").agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.select("column_name", F.struct((-F.col("n")).alias("minus"), "level").alias("place"), "n", F.lit(1).cast("long").alias("one"))
    ranked = running_totals(ordered, "place", ["one"], descending=False, groups=["column_name"])
    return ranked.select("column_name", F.col("place.level").alias("level"), "n", (F.col("cum_one") - 1).cast("int").alias("rank"))


def fit_slots(train: DataFrame, label: str, exclude: list[str] | None = None) -> SlotModel:
    """The layout of ``label ~ . - exclude``. Text columns with fewer than two levels are left out, as in ``fit_matrix``.
    What reaches the driver is the number of levels of each column."""
    exclude = {label, *(exclude or [])}
    names = [f.name for f in train.schema.fields if f.name not in exclude]
    text = [c for c in names if isinstance(train.schema[c].dataType, T.StringType)]
    levels = stage(level_ranks(train, text), "levels") if text else train.sparkSession.createDataFrame([], "column_name string, level string, n long, rank int")
    counts = dict(levels.groupBy("column_name").count().collect())
    columns, slot = [], 0
    for name in names:
        n = counts.get(name, 0) if name in text else 0
        if name in text and n < 2:
            continue
        columns.append((name, slot, n))
        slot += n - 1 if n else 1
    return SlotModel(columns, levels, slot)


def apply_slots(model: SlotModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with ``slots array<int>`` and ``values array<double>``: the slots of each row that are not zero.

    The dictionary carries no broadcast hint: its size is measured, and a large one is joined by shuffle.
    """
    out = df.select(F.struct("*").alias("_row"))
    filled: list[Column] = []
    for k, (name, first, levels) in enumerate(model.columns):
        cell = F.col("_row")[name]
        if not levels:
            filled.append(F.when(cell != 0, F.struct(F.lit(first).alias("slot"), cell.cast("double").alias("value"))))
            continue
        known = model.levels.where((F.col("column_name") == name) & (F.col("rank") < levels - 1)) \
            .select(F.col("level").alias(f"_l{k}"), F.col("rank").alias(f"_r{k}"))
        out = out.join(known, cell == F.col(f"_l{k}"), "left")
        rank = F.col(f"_r{k}")
        filled.append(F.when(rank.isNotNull(), F.struct((rank + first).alias("slot"), F.lit(1.0).alias("value"))))
    cells = F.filter(F.array(*filled), lambda c: c.isNotNull())
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], F.transform(cells, lambda c: c["slot"]).alias("slots"),
                      F.transform(cells, lambda c: c["value"]).alias("values"))


def dense(slots: str = "slots", values: str = "values", size: int = 0) -> Column:
    """The whole vector as an array, for layouts narrow enough to write out."""
    filled = F.map_from_arrays(F.col(slots), F.col(values))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(filled, i), F.lit(0.0)))
