"""Reading the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.schemas import TABLES
from orderlens.sources.inference import read_inferred

# Fixed value: the missing-value marker written in the source CSVs.
NA = "NA"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "csv", null_value: str = NA) -> DataFrame:
    """Read one headered CSV (or Parquet) table with a declared schema, or without one with the types
    that all its cells fit (``orderlens.sources.inference``).

    Columns are found by their header names (in any case), so files may order them in any way
    and hold further ones, which are not returned; a missing column is an
    error. All files of a folder must share one header. Text that does not
    parse as the declared type becomes null (PERMISSIVE mode) instead of
    failing the job, as ``NA`` does; ``unparsed_counts`` counts such cells.
    """
    if fmt != "csv":
        df = spark.read.format(fmt).load(path)
        return df if schema is None else df.select(*[F.col(f.name).cast(f.dataType) for f in _pick(df.columns, schema, path)])
    reader = (spark.read.option("header", "true").option("nullValue", null_value).option("mode", "PERMISSIVE"))
    if schema is None:
        return read_inferred(spark, path, null_value)
    header = spark.read.option("header", "true").csv(path).columns       # reads the first line only
    declared = {f.name.lower(): f for f in _pick(header, schema, path)}
    in_file = T.StructType([declared.get(name.lower(), T.StructField(name, T.StringType())) for name in header])
    return reader.schema(in_file).option("enforceSchema", "false").csv(path).select(*schema.names)


def _pick(columns: list[str], schema: T.StructType, path: str) -> list[T.StructField]:
    missing = sorted({n.lower() for n in schema.names} - {c.lower() for c in columns})
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return list(schema.fields)


def unparsed_counts(spark: SparkSession, path: str, schema: T.StructType, null_value: str = NA) -> DataFrame:
    """Cells per declared column that hold text which is not of the declared type (one row, one pass)."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = read_table(spark, path, text, null_value=null_value)
    return raw.agg(*[F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name)
                     for f in schema.fields])


def load_sources(spark: SparkSession, paths: dict[str, str], fmt: str = "csv",
                 null_value: str = NA, infer: bool = False) -> dict[str, DataFrame]:
    """Named input-path set -> named DataFrames with the declared schemas, or with ``infer`` the inferred ones.

    ``paths`` maps table names (``products``, ``orders``, ``order_items``,
    ``order_payments``, ``order_reviews``) to files or folders. A holdout set
    simply omits ``order_reviews``.
    """
    out = {}
    for name, path in paths.items():
        if name not in TABLES:
            raise KeyError(f"unknown table {name!r}; expected one of {sorted(TABLES)}")
        out[name] = read_table(spark, path, None if infer else TABLES[name], fmt=fmt, null_value=null_value)
    return out
