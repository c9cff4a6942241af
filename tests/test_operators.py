"""Quantile, running totals, profiling, cleaning and the CSV reader."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orderlens import schemas
from orderlens.operators import cleaning as cl
from orderlens.operators import quality as q
from orderlens.operators.cumulative import running_totals
from orderlens.operators.quantile import exact_quantile
from orderlens.sources.tables import load_sources, read_table


def disc(values, p):
    s = sorted(values)
    return s[min(len(s), max(1, math.ceil(p * len(s)))) - 1]


@pytest.mark.parametrize("n", [1, 7, 10, 11, 20, 500])
@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_quantile_small(spark, n, p):
    vals = [float((i * 7919) % 101) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert exact_quantile(df, "x", p, rows_per_range=5) == disc(vals, p)


def test_quantile_hot_value_and_nulls(spark):
    rnd = random.Random(7)
    vals = [5.0] * 400 + [rnd.uniform(0, 10) for _ in range(800)]     # a third of rows share one value
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)] * 50, "x double")
    for p in (0.05, 0.3, 0.34, 0.5, 0.66, 0.9, 0.999):
        assert exact_quantile(df, "x", p, rows_per_range=10) == disc(vals, p)


def test_quantile_all_equal_and_empty(spark):
    df = spark.createDataFrame([(3.0,)] * 100, "x double")
    assert exact_quantile(df, "x", 0.9, rows_per_range=5) == 3.0
    with pytest.raises(ValueError):
        exact_quantile(spark.createDataFrame([], "x double"), "x", 0.9)


def test_running_totals_many_ranges(spark):
    rnd = random.Random(3)
    rows = [(float(v), rnd.randint(0, 3), rnd.randint(0, 3)) for v in rnd.sample(range(10_000), 2_000)]
    df = spark.createDataFrame(rows, "score double, pos long, neg long")
    out = running_totals(df, "score", ["pos", "neg"], descending=True, rows_per_range=97)
    got = {r["score"]: (r["cum_pos"], r["cum_neg"], r["total_pos"]) for r in out.collect()}
    acc_p = acc_n = 0
    tp = sum(r[1] for r in rows)
    for s, p_, n_ in sorted(rows, key=lambda r: -r[0]):
        acc_p += p_
        acc_n += n_
        assert got[s] == (acc_p, acc_n, tp)
    asc = running_totals(df, "score", ["pos"], descending=False, rows_per_range=97)
    low = min(rows)[0]
    assert asc.filter(F.col("score") == low).first()["cum_pos"] == min(rows)[1]


def test_null_counts_and_long(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, None, "b"), (3, 2.0, None)], "a int, b double, c string")
    assert q.null_counts(df).first().asDict() == {"a": 1, "b": 2, "c": 1}
    long = {r["column_name"]: r["null_count"] for r in q.null_counts_long(df).collect()}
    assert long == {"a": 1, "b": 2, "c": 1}


def test_describe_and_counts(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None)], "a int, b double")
    d = {r["column_name"]: r for r in q.describe_table(df).collect()}
    assert d["a"]["count"] == 3 and d["a"]["mean"] == 2.0 and d["a"]["stddev"] == 1.0
    assert d["b"]["count"] == 2 and (d["b"]["min"], d["b"]["max"]) == (2.0, 4.0)
    vc = q.value_counts(spark.createDataFrame([(None,), (2,), (1,), (2,)], "v int"), "v").collect()
    assert [(r["v"], r["count"]) for r in vc] == [(None, 1), (1, 1), (2, 2)]
    dup = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, "y")], "a int, b string")
    assert q.duplicate_count(dup).first()[0] == 2
    assert q.duplicate_count(dup.limit(0)).first()[0] == 0
    rc = {r["table_name"]: r["row_count"] for r in q.row_counts({"d": dup, "e": df}).collect()}
    assert rc == {"d": 4, "e": 3}
    info = q.column_info(df).collect()
    assert [(r["column_name"], r["data_type"]) for r in info] == [("a", "int"), ("b", "double")]


def test_cleaning(spark):
    df = spark.createDataFrame([(None, None), ("NA", "NA"), ("k", None), ("k", None)], "id string, v string")
    assert cl.drop_empty_rows(df).count() == 3              # a row of "NA" text is not empty
    assert cl.drop_sentinel(df, "id").count() == 2          # drops "NA" and null ids
    assert cl.dedupe(df).count() == 3
    assert cl.drop_incomplete(df).count() == 1
    nums = spark.createDataFrame([(1, 0), (None, 3), (2, -1)], "id long, n int")
    assert cl.drop_sentinel(nums, "id").count() == 2        # numeric key: null check only
    assert cl.filter_positive(nums, "n").count() == 1
    assert cl.require(nums, "id").count() == 2
    imp = cl.impute_mean(spark.createDataFrame([(2,), (3,), (None,)], "n int"), "n")
    assert sorted(r["n"] for r in imp.collect()) == [2, 2, 3]      # mean 2.5 truncated
    with pytest.raises(ValueError):
        cl.column_mean(spark.createDataFrame([(None,)], "n int"), "n")


def test_csv_na_markers(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(
        "order_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,"
        "order_delivered_customer_date,order_estimated_delivery_date\n"
        "o1,delivered,2018-01-01 10:00:00,NA,2018-01-02 10:00:00,,2018-01-10 00:00:00\n"
        "NA,delivered,2018-01-01 10:00:00,2018-01-01 10:00:00,NA,NA,NA\n"
        "o3,delivered,not a date,2018-01-01 10:00:00,NA,NA,NA\n")
    (tmp_path / "items.csv").write_text(
        "order_id,order_item_id,product_id,price,shipping_cost\n"
        "o1,1,p1,NA,2.5\no1,NA,p2,3.0,\n")
    t = load_sources(spark, {"orders": str(tmp_path / "orders.csv"), "order_items": str(tmp_path / "items.csv")})
    o = {r["order_id"]: r for r in t["orders"].collect()}
    assert None in o and "NA" not in o                      # NA key -> null
    assert o["o1"]["order_approved_at"] is None and o["o1"]["order_delivered_customer_date"] is None
    assert o["o3"]["order_purchase_timestamp"] is None       # unparseable text -> null
    items = t["order_items"].collect()
    assert items[0]["price"] is None and items[1]["order_item_id"] is None
    assert items[1]["shipping_cost"] is None
    assert t["order_items"].schema == schemas.ORDER_ITEMS
    pq = read_table(spark, str(tmp_path / "items.csv"), None)   # inferred schema path
    assert pq.count() == 2


def test_fixed_sum_exact_and_overflow_safe(spark):
    from orderlens.functions.expressions import fixed_sum
    big = spark.createDataFrame([("k", 4e12 + 0.25)] * 3 + [("j", 0.1), ("j", 0.2)], "g string, v double")
    got = {r["g"]: r["s"] for r in big.groupBy("g").agg(fixed_sum("v").alias("s")).collect()}
    assert got["k"] == 12e12 + 0.75                   # scaled units exceed the bigint range
    assert got["j"] == 0.3                            # exact decimal sum, not 0.30000000000000004
    one = spark.createDataFrame([(0.1 * i,) for i in range(1, 101)], "v double")
    parts = [one.repartition(n).agg(fixed_sum("v")).first()[0] for n in (1, 3, 7)]
    assert parts[0] == parts[1] == parts[2] == 505.0


def test_describe_matches_spark_describe(spark):
    from orderlens.sources.driver_views import products_view
    df = products_view(spark, "/root/testdata/sf0.001")
    cols = q.numeric_columns(df)
    ours = {r["column_name"]: r for r in q.describe_table(df, cols).collect()}
    theirs = {r["summary"]: r for r in df.describe(*cols).collect()}
    for c in cols:
        assert ours[c]["count"] == int(theirs["count"][c])
        assert ours[c]["mean"] == pytest.approx(float(theirs["mean"][c]), rel=1e-12)
        assert ours[c]["stddev"] == pytest.approx(float(theirs["stddev"][c]), rel=1e-12)
        assert ours[c]["min"] == float(theirs["min"][c]) and ours[c]["max"] == float(theirs["max"][c])


def test_csv_columns_are_found_by_header_name(spark, tmp_path):
    from orderlens.sources.tables import unparsed_counts
    (tmp_path / "items.csv").write_text("seller_id,shipping_cost,price,product_id,Order_Item_Id,order_id\ns1,2.5,10.5,p1,1,o1\ns2,x,7,p2,NA,o2\n")
    df = read_table(spark, str(tmp_path / "items.csv"), schemas.ORDER_ITEMS)
    assert df.schema == schemas.ORDER_ITEMS
    assert sorted(map(tuple, df.collect())) == [("o1", 1, "p1", 10.5, 2.5), ("o2", None, "p2", 7.0, None)]
    assert unparsed_counts(spark, str(tmp_path / "items.csv"), schemas.ORDER_ITEMS).first().asDict() == {
        "order_id": 0, "order_item_id": 0, "product_id": 0, "price": 0, "shipping_cost": 1}
    (tmp_path / "short.csv").write_text("order_id,price\no1,1\n")
    with pytest.raises(ValueError, match="product_id"):
        read_table(spark, str(tmp_path / "short.csv"), schemas.ORDER_ITEMS)


def test_running_totals_special_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(None, 1), (nan, 2), (inf, 4), (0.5, 8), (-inf, 16)], "v double, n long")
    got = [(r["n"], r["cum_n"]) for r in running_totals(df, "v", ["n"], rows_per_range=1).collect()]
    assert sorted(got) == [(1, 31), (2, 2), (4, 6), (8, 14), (16, 30)]         # NaN first, null last
    big = spark.createDataFrame([(2**53 + k, 1) for k in range(40)], "v long, n long")
    out = running_totals(big, "v", ["n"], descending=False, rows_per_range=3)
    assert out.schema["v"].dataType.simpleString() == "bigint"
    assert {r["v"]: r["cum_n"] for r in out.collect()} == {2**53 + k: k + 1 for k in range(40)}


def test_quantile_nan_and_infinity(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(x,) for x in (nan, 1.0, 3.0, 2.0, 0.5)], "x double")
    assert exact_quantile(df, "x", 0.5) == 2.0
    ends = spark.createDataFrame([(x,) for x in (-inf, 1.0, inf)], "x double")
    assert [exact_quantile(ends, "x", p) for p in (0.1, 0.5, 1.0)] == [-inf, 1.0, inf]


def test_split_weights_are_not_rounded(spark):
    from orderlens.ml.matrix import split
    n = {r["split"]: r["count"] for r in split(spark.range(40_000), "id", (0.995, 0.005)).groupBy("split").count().collect()}
    assert 120 <= n["validation"] <= 280 and sum(n.values()) == 40_000


def test_describe_text(spark):
    df = spark.createDataFrame([("b", 1, None), ("a", 2, None), (None, 3, None)], "x string, n int, y string")
    assert [tuple(r) for r in q.describe_text(df).collect()] == [("x", 2, "a", "b"), ("y", 0, None, None)]
    assert q.describe_text(df.select("n")).count() == 0
