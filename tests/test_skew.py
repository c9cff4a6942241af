"""Hot keys: a third of the line items, payments and reviews on one order, a
third of the items on one product, and a third of the order rows exact copies
of one order. The tables are derived from the driver's
sf0.01 tables (keys remapped, no rows added or removed); every affected query
must still equal its DuckDB oracle exactly."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
import __spark_entry__ as entry
from orderlens import oracle

HOT_ORDER = 7
HOT_PART = 1

QUERIES = ["f6_order_features", "f7_item_aggregates", "f9_shipping_threshold", "f10_item_features", "f12_payment_aggregates",
           "f16_payment_features", "f17_latest_review", "f20_review_features", "f21_base_table",
           "f21_base_table_left", "p6_duplicate_count_payments", "j1_items_products", "m2_split"]


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    third = (F.col("l_orderkey") + F.col("l_linenumber")) % 3
    li = li.withColumn("l_orderkey", F.when(third == 0, F.lit(HOT_ORDER).cast("long")).otherwise(F.col("l_orderkey"))) \
           .withColumn("l_partkey", F.when(third == 1, F.lit(HOT_PART).cast("long")).otherwise(F.col("l_partkey")))
    li.write.parquet(str(out / "lineitem.parquet"))
    ev = spark.read.parquet(f"{SF_MID}/events.parquet")
    ev.withColumn("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(2 * HOT_ORDER).cast("long"))
                  .otherwise(F.col("event_id"))).write.parquet(str(out / "events.parquet"))
    orders = spark.read.parquet(f"{SF_MID}/orders.parquet")
    copy = orders.filter(F.col("o_orderkey") == HOT_ORDER).first()
    hot = F.col("o_orderkey") % 3 == 0          # a third of the order rows become copies of one order
    orders.select([F.when(hot, F.lit(copy[c])).otherwise(F.col(c)).cast(orders.schema[c].dataType).alias(c)
                   for c in orders.columns]).write.parquet(str(out / "orders.parquet"))
    for name in ("part", "labels"):
        spark.read.parquet(f"{SF_MID}/{name}.parquet").write.parquet(str(out / f"{name}.parquet"))
    return str(out)


@pytest.fixture(scope="module")
def duck(skewed_dir):
    con = duckdb.connect()
    for name in os.listdir(skewed_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{skewed_dir}/{name}/*.parquet')")
    return con


def _canon(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_hot_keys_match_oracle(spark, skewed_dir, duck, name):
    df = entry.queries()[name](spark, skewed_dir)
    cols = df.columns
    res = duck.execute(oracle.ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = [tuple(r[dcols.index(c)] for c in cols) for r in res.fetchall()]
    assert sorted(dcols) == sorted(cols)
    assert _canon(df.collect()) == _canon(drows)


def test_hot_order_really_is_hot(spark, skewed_dir):
    li = spark.read.parquet(f"{skewed_dir}/lineitem.parquet")
    share = li.filter(F.col("l_orderkey") == HOT_ORDER).count() / li.count()
    assert share > 0.3
    orders = spark.read.parquet(f"{skewed_dir}/orders.parquet")
    assert orders.filter(F.col("o_orderkey") == HOT_ORDER).count() / orders.count() > 0.3
    base = entry.queries()["f21_base_table"](spark, skewed_dir)
    assert base.filter(F.col("order_id") == HOT_ORDER).count() <= 1
