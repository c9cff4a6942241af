"""README-only extras: R2 outlier caps, R3 stacking, R4 class weights and stratified samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.ml.evaluation import positive_probability
from orderlens.ml.matrix import fold_column
from orderlens.ml.models import MODEL_SEED, fit_model
from orderlens.operators.cumulative import running_totals
from orderlens.operators.quantile import exact_quantiles, grouped_quantiles
from orderlens.session import stage


# ------------------------------------------------------------------ R2

def fit_caps(df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99) -> dict[str, tuple[float, float]]:
    """Exact ``lo``/``hi`` quantiles per column (fitted state)."""
    return {c: tuple(exact_quantiles(df, c, [lo, hi])) for c in cols}


def cap_outliers(df: DataFrame, caps: dict[str, tuple[float, float]]) -> DataFrame:
    """Clamp each column into its fitted ``[low, high]`` (nulls stay null)."""
    return df.withColumns({c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
                           for c, (lo, hi) in caps.items()})


def fit_caps_by(df: DataFrame, by: str, col: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """``by, low, high``: exact ``lo``/``hi`` quantiles of every group (a null group is one of them), as a table."""
    return grouped_quantiles(df, [by], col, [lo, hi]).withColumnsRenamed({"q0": "low", "q1": "high"})


def cap_outliers_by(df: DataFrame, caps: DataFrame, by: str, col: str) -> DataFrame:
    """Clamp the column into the fitted bounds of its row's group; rows of a group without bounds stay as they are.

    The bounds are joined without a hint: one row per group, broadcast by measured size or joined by shuffle, where a hot
    group is split as any skewed join is.
    """
    bounds = caps.select(F.col(by).alias("_by"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    joined = df.join(bounds, F.col(by).eqNullSafe(F.col("_by")), "left")
    capped = F.least(F.greatest(F.col(col), F.coalesce("_low", F.col(col))), F.coalesce("_high", F.col(col)))
    return joined.withColumn(col, F.when(F.col(col).isNotNull(), capped)).select(*df.columns)


# ------------------------------------------------------------------ R4

def draw(key: str, seed: int) -> "F.Column":
    """A 60-bit number from the md5 of ``seed:key``: a function of the key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def stratified_sample(df: DataFrame, label: str, key: str, size: int | dict | None = None, seed: int = MODEL_SEED) -> DataFrame:
    """Exactly ``size`` rows of every class (a number for all, a number per class, or the size of the smallest class; all rows
    of a class that has no more), those with the smallest ``draw`` of their key.

    No class is sorted in one task: running counts over ranges of (class, draw) name the draw that holds the last
    wanted row, rows with a smaller draw are taken as they are. Rows at that very draw (repeated keys) are settled exactly: equal rows are
    counted first, then taken in the order of their columns, as many copies as are still wanted. A null label is a class.
    """
    rows = df.withColumn("_h", draw(key, seed))
    counts = stage(rows.groupBy(label, "_h").agg(F.count(F.lit(1)).alias("_n")), "sample_draws")
    curve = running_totals(counts, "_h", ["_n"], descending=False, groups=[label], staged=True)
    if isinstance(size, dict):
        wanted = F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(c)), F.lit(n)) for c, n in size.items()], F.lit(0)).cast("long")
    else:
        least = size if size is not None else counts.groupBy(label).agg(F.sum("_n").alias("n")).agg(F.min("n")).first()[0]
        wanted = F.lit(least or 0).cast("long")
    # the last draw of a class that is needed, and how many of its rows are
    cut = curve.withColumn("_want", wanted).where((F.col("cum__n") - F.col("_n") < F.col("_want"))).groupBy(label) \
        .agg(F.max("_h").alias("_cut"), F.max_by(F.least(F.col("_n"), F.col("_want") - F.col("cum__n") + F.col("_n")), "_h").alias("_left"),
             F.max_by("_n", "_h").alias("_there"))
    cut = cut.withColumnRenamed(label, "_class")
    near = rows.join(cut, F.col(label).eqNullSafe(F.col("_class")))
    whole = near.where((F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & (F.col("_left") == F.col("_there")))).select(*df.columns)
    tied = near.where((F.col("_h") == F.col("_cut")) & (F.col("_left") < F.col("_there"))).groupBy(*df.columns, "_left").agg(F.count(F.lit(1)).alias("_copies"))
    if not tied.isEmpty():
        before = Window.partitionBy(label).orderBy(*df.columns).rowsBetween(Window.unboundedPreceding, -1)
        take = F.least(F.col("_copies"), F.col("_left") - F.coalesce(F.sum("_copies").over(before), F.lit(0)))
        runs = tied.withColumn("_take", take).where("_take > 0") \
            .withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_take") - 1, F.lit(10_000).cast("long")))).repartition(*df.columns, "_run")
        copies = runs.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(10_000).cast("long"), F.col("_take") - F.col("_run")))))
        whole = whole.unionByName(copies.select(*df.columns))
    return whole


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight = rows / (classes * rows_of_this_class)`` (balanced); a null label is a class of its own and gets no weight.

    The per-class table, one row per label value, carries no hint: its measured size decides on a broadcast.
    """
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = per_class.select(
        label, (F.sum("_n").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n"))).alias("weight"))
    return df.join(weights, label, "left")


# ------------------------------------------------------------------ R3

@dataclass
class StackModel:
    kinds: list[str]
    bases: list
    meta: object


def _base_scores(models, kinds, df: DataFrame) -> DataFrame:
    out = df
    for kind, m in zip(kinds, models):
        out = m.transform(out).withColumn(f"p_{kind}", positive_probability()) \
               .drop("rawPrediction", "probability", "prediction")
    return out


def fit_stack(train: DataFrame, kinds=("gbt", "rf", "lr"), folds: int = 2, key: str = "order_id",
              seed: int = MODEL_SEED) -> StackModel:
    """Stack base learners under a logistic regression fed with out-of-fold
    positive probabilities (each row scored by models that never saw it).
    Base learners are then refitted on all rows for scoring."""
    kinds = list(kinds)
    data = train.withColumn("_fold", fold_column(key, folds, seed))
    oof = None
    for f in range(folds):
        fit_part = data.filter(F.col("_fold") != f)
        held = data.filter(F.col("_fold") == f)
        models = [fit_model(k, fit_part, seed) for k in kinds]
        part = _base_scores(models, kinds, held)
        oof = part if oof is None else oof.unionByName(part)
    meta_in = VectorAssembler(inputCols=[f"p_{k}" for k in kinds], outputCol="meta_features") \
        .transform(oof)
    meta = fit_model("lr", meta_in, seed, features="meta_features")
    bases = [fit_model(k, train, seed) for k in kinds]
    return StackModel(kinds, bases, meta)


def apply_stack(stack: StackModel, df: DataFrame) -> DataFrame:
    scored = _base_scores(stack.bases, stack.kinds, df)
    meta_in = VectorAssembler(inputCols=[f"p_{k}" for k in stack.kinds], outputCol="meta_features") \
        .transform(scored)
    return stack.meta.transform(meta_in)
