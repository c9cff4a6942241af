"""Type inference from raw cells: the lattice, merging, and reading by inferred types."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.sources.inference import TYPES, infer_types, merge_types, raw_cells, read_inferred, schema_of
from orderlens.sources.tables import load_sources, read_table

CELLS = {
    "whole": (["1", "-2", "+3", None, "9223372036854775807"], "bigint"),
    "too_long": (["1", "9223372036854775808"], "double"),
    "mixed_numbers": (["1", "2.5", ".5", "1e3", "NaN", "-Infinity"], "double"),
    "yes_no": (["true", "FALSE", None], "boolean"),
    "times": (["2020-01-31", "2020-01-31 10:20", "2020-01-31T10:20:30.123456"], "timestamp"),
    "no_such_day": (["2020-02-30", "2020-02-01"], "text"),
    "number_and_time": (["1", "2020-01-31"], "text"),
    "number_and_word": (["1", "x"], "text"),
    "flag_and_number": (["true", "1"], "text"),
    "line_feed": (["1\n", "2"], "text"),
    "spaces": ([" 1", "2"], "text"),
    "zone": (["2020-01-31T10:20:30Z", "2020-01-31"], "text"),
    "empty": ([None, None], "text"),
    "odd.name `x`": (["1"], "bigint"),
}


def frame(spark, columns):
    n = max(len(v) for v in columns.values())
    rows = list(zip(*(v + [None] * (n - len(v)) for v in columns.values())))
    return spark.createDataFrame(rows, T.StructType([T.StructField(k, T.StringType()) for k in columns]))


def test_lattice(spark):
    columns = {k: v for k, (v, _) in CELLS.items() if "`" not in k}
    got = {r["column_name"]: r for r in infer_types(frame(spark, columns)).collect()}
    assert {k: r["type"] for k, r in got.items()} == {k: t for k, (_, t) in CELLS.items() if "`" not in k}
    assert got["mixed_numbers"]["bigints"] == 1 and got["mixed_numbers"]["doubles"] == 6 and got["empty"]["cells"] == 0


def test_names_with_dots(spark):
    got = infer_types(frame(spark, {"odd.name": ["1"], "b c": ["x"]})).collect()
    assert [(r["column_name"], r["type"]) for r in sorted(got)] == [("odd.name", "bigint"), ("b c", "text")]


def test_merge_equals_whole(spark):
    days = [{"a": ["1", "2"], "b": ["2020-01-01"], "c": ["true"]}, {"a": ["2.5"], "b": [None], "c": ["false"]}, {"a": [None], "b": ["soon"], "c": [None]}]
    parts = [infer_types(frame(spark, d)) for d in days]
    whole = infer_types(frame(spark, {k: [x for d in days for x in d[k]] for k in "abc"}))
    assert sorted(merge_types(*parts).collect()) == sorted(whole.collect())
    assert schema_of(merge_types(*parts)).fieldNames() == ["a", "b", "c"]
    assert [f.dataType for f in schema_of(merge_types(*parts[:2]))] == [TYPES["double"], TYPES["timestamp"], TYPES["boolean"]]


def test_read_inferred(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v,at,note\n1,NA,2020-01-31,a\n9007199254740993,2.5,NA,\n")
    got = read_inferred(spark, str(tmp_path / "t.csv"))
    assert [(f.name, f.dataType) for f in got.schema] == [("k", T.LongType()), ("v", T.DoubleType()), ("at", T.TimestampNTZType()), ("note", T.StringType())]
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(1, None, dt.datetime(2020, 1, 31), "a"), (9007199254740993, 2.5, None, None)]
    assert read_table(spark, str(tmp_path / "t.csv")).schema == got.schema
    assert load_sources(spark, {"orders": str(tmp_path / "t.csv")}, infer=True)["orders"].schema == got.schema


def test_file_without_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    assert [f.dataType for f in read_inferred(spark, str(tmp_path / "t.csv")).schema] == [T.StringType()] * 2
    assert raw_cells(spark, str(tmp_path / "t.csv")).count() == 0


def test_one_aggregation(spark):
    plan = infer_types(frame(spark, {"a": ["1"], "b": ["x"]}).repartition(3))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Window" not in plan


def test_describe_keeps_long_keys(spark):
    from orderlens.operators.quality import describe_table
    df = spark.createDataFrame([(9007199254740993, 1.5), (5, float("nan"))], "k long, x double").withColumn("d", F.col("k").cast("decimal(20,2)"))
    got = {r["column_name"]: r for r in describe_table(df).collect()}
    assert got["k"]["max_exact"] == "9007199254740993" and got["d"]["max_exact"] == "9007199254740993.00" and got["x"]["max_exact"] is None
    assert describe_table(df.select(F.lit("x").alias("t"))).count() == 0


@pytest.mark.parametrize("values,total", [
    ([4e-7] * 10, 4e-6), ([1e15, 0.125, -1e15], 0.125), ([float("inf"), 1.0], float("inf")), ([None, None], None), ([-0.1, 0.1, -0.3], -0.3),
    ([123456.789] * 3, 370370.367)])
def test_order_safe_sum(spark, values, total):
    from orderlens.functions.expressions import fixed_sum
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert {df.repartition(n).agg(fixed_sum("v")).first()[0] for n in (1, 2, 5)} == {total}


def test_sum_with_nan(spark):
    from orderlens.functions.expressions import fixed_sum
    got = spark.createDataFrame([(float("nan"),), (1.0,)], "v double").agg(fixed_sum("v")).first()[0]
    assert got != got
