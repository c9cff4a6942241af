"""The feature matrix and the train/validation split.

The formula is fitted once, on training rows, and the fitted model is applied
to every other table (validation, holdout), so all of them get the same
one-hot layout. Unseen category levels and nulls count as the reference level
(all zeros) instead of failing the job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import RFormula, RFormulaModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class MatrixModel:
    formula: str
    model: RFormulaModel
    constant_columns: list[str] = field(default_factory=list)
    #: Levels of every text column in the formula, by descending frequency; the last one is the reference level.
    levels: dict[str, list[str]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return apply_matrix(self, df)


#: The most levels that all text columns of a formula may have together; they are held on the driver and in the plan.
MAX_LEVELS = 10_000


def text_levels(df: DataFrame, columns: list[str], most: int = MAX_LEVELS) -> dict[str, list[str]]:
    """The levels of text columns by descending frequency, equally frequent ones in alphabetical order.

    One job; what reaches the driver is one row per level, as many as the one-hot vector has slots. More than ``most``
    are an error: ``ml.slots`` builds the same matrix from a joined table of levels, however many there are.
    """
    if not columns:
        return {}
    counts = df.select(*columns).unpivot([], columns, "column", "level").where("level is not null") \
        .groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    found = counts.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the text columns {columns} have more than {most} levels; use fit_slots")
    found = sorted(found, key=lambda r: (-r["n"], r["level"]))
    return {c: [r["level"] for r in found if r["column"] == c] for c in columns}


def _known_levels(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Unseen levels and nulls of the given columns as the reference level."""
    return df.withColumns({c: F.when(F.col(c).isin(known), F.col(c)).otherwise(F.lit(known[-1])) for c, known in levels.items()})


def fit_matrix(train: DataFrame, label: str, exclude: list[str] | None = None,
               interactions: list[tuple[str, str]] | None = None) -> MatrixModel:
    """M1: ``label ~ . - exclude`` (plus ``a:b`` interaction terms, R1).

    Text columns are one-hot encoded (levels by descending frequency, the
    last dropped), numbers are used as they are; a null or NaN number fails the
    job. Text columns with fewer than two levels are left out.
    """
    exclude = list(exclude or [])
    text = [f.name for f in train.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude and f.name != label]
    levels = text_levels(train, text)
    constant = [c for c in text if len(levels[c]) < 2]
    levels = {c: known for c, known in levels.items() if c not in constant}
    terms = " ".join(f"- {c}" for c in exclude + constant)
    inter = " ".join(f"+ {a}:{b}" for a, b in (interactions or []))
    formula = f"{label} ~ . {terms} {inter}".strip()
    model = RFormula(formula=formula).fit(_known_levels(train, levels))
    return MatrixModel(formula=formula, model=model, constant_columns=constant, levels=levels)


def apply_matrix(matrix: MatrixModel, df: DataFrame) -> DataFrame:
    """Add ``features`` (and ``label`` when the label column is present); the other columns stay as they are."""
    own = {f"_own_{c}": F.col(c) for c in matrix.levels}
    out = matrix.model.transform(_known_levels(df.withColumns(own), matrix.levels))
    return out.withColumns({c: F.col(f"_own_{c}") for c in matrix.levels}).drop(*own)


# Fixed value: the reference's split seed.
SPLIT_SEED = 123


def hash_bucket(key: str | Column, seed: int = SPLIT_SEED, buckets: int = 100) -> Column:
    """0..buckets-1 from the md5 of ``seed:key``: a function of the key only,
    so the split does not change with partitioning or a recomputed task."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def split(df: DataFrame, key: str, weights=(0.8, 0.2), seed: int = SPLIT_SEED,
          names=("train", "validation")) -> DataFrame:
    """M2: add ``split`` naming the part of each row, by the hash of its key.

    Weights hold to one part in a million; the hash's percent decides first,
    its next digits within a percent.
    """
    if len(weights) != len(names):
        raise ValueError("one name per weight")
    fine = hash_bucket(key, seed) * 10_000 + hash_bucket(key, seed, 1_000_000) / 100
    part, acc = None, 0.0
    for w, name in zip(weights[:-1], names):
        acc += w / float(sum(weights))
        test = fine < round(acc * 1_000_000)
        part = F.when(test, F.lit(name)) if part is None else part.when(test, F.lit(name))
    return df.withColumn("split", F.lit(names[-1]) if part is None else part.otherwise(F.lit(names[-1])))


def fold_column(key: str, folds: int, seed: int = SPLIT_SEED) -> Column:
    """Deterministic fold id in ``[0, folds)`` for cross-validation."""
    return hash_bucket(key, seed + 1, folds)
