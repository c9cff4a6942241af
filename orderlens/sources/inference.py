"""Column types of files without a declared schema, by one aggregation over their raw cells.

Every cell that is not null is tested against each type; what is kept per column are the counts of cells that fit.
Counts of several files, folders or days add up (``merge_types``), so a table that grows is inferred from its new
files alone. The type of a column is the narrowest that all its cells fit:

    boolean, bigint < double, timestamp  <  text

Cells of two kinds that have no common type but text (a number and a date) widen the column to text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark types of the lattice, narrowest first where one contains the other.
TYPES = {"boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampNTZType(),
         "text": T.StringType()}
_KINDS = {"booleans": "boolean", "bigints": "bigint", "doubles": "double", "timestamps": "timestamp"}
_INTEGER = r"^[+-]?[0-9]{1,19}\z"
_NUMBER = r"^[+-]?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]{1,6})?)?)?\z"


def _fits(cell: Column) -> dict[str, Column]:
    return {
        "booleans": F.lower(cell).isin("true", "false"),
        "bigints": cell.rlike(_INTEGER) & cell.try_cast("bigint").isNotNull(),
        "doubles": (cell.rlike(_NUMBER) | cell.isin("NaN", "Infinity", "-Infinity")) & cell.try_cast("double").isNotNull(),
        "timestamps": cell.rlike(_TIME) & cell.try_cast("timestamp_ntz").isNotNull(),
    }


def _narrowest() -> Column:
    """The type by the counts of one column; a column without a cell is text."""
    out = None
    for kind, name in _KINDS.items():
        all_fit = (F.col("cells") > 0) & (F.col(kind) == F.col("cells"))
        out = F.when(all_fit, name) if out is None else out.when(all_fit, name)
    return out.otherwise("text")


def raw_cells(spark: SparkSession, path: str, null_value: str = "NA") -> DataFrame:
    """The cells of a headered CSV file or folder as text, ``null_value`` and empty cells as null."""
    header = spark.read.option("header", "true").csv(path).columns                  # reads the first line only
    text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    return spark.read.options(header="true", nullValue=null_value, enforceSchema="false").schema(text).csv(path)


def infer_types(raw: DataFrame) -> DataFrame:
    """``position, column_name, cells, booleans, bigints, doubles, timestamps, type``, one row per column of ``raw`` (text).

    One pass with partial aggregation, whatever the number of columns. Null cells are not counted.
    """
    names = raw.columns
    counted = []
    for i, name in enumerate(names):
        cell = F.col(f"`{name}`")
        counted.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("column_name"), F.count(cell).alias("cells"),
                                *[F.count_if(fits).alias(kind) for kind, fits in _fits(cell).items()]))
    rows = raw.agg(F.array(*counted).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return rows.withColumn("type", _narrowest())


def merge_types(*parts: DataFrame) -> DataFrame:
    """The types over several inferred parts (files, days) of one table: counts add up, conflicts widen."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("position", "column_name").agg(*[F.sum(c).alias(c) for c in ("cells", *_KINDS)]).withColumn("type", _narrowest())


def schema_of(types: DataFrame) -> T.StructType:
    """The inferred table schema (one row per column reaches the driver)."""
    return T.StructType([T.StructField(r["column_name"], TYPES[r["type"]]) for r in types.orderBy("position").collect()])


def typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """The raw cells in the inferred types; a cell that does not fit (of a later file) becomes null."""
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_inferred(spark: SparkSession, path: str, null_value: str = "NA") -> DataFrame:
    """A headered CSV file or folder with inferred column types (two passes over the files)."""
    raw = raw_cells(spark, path, null_value)
    return typed(raw, schema_of(infer_types(raw)))
