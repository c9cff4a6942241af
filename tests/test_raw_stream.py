"""Base rows from the raw streams: equal to the batch base, across a restart, each finished order once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from orderlens import catalog
from orderlens.fitting import fit_scorer, score_tables
from orderlens.plans.base import build_base
from orderlens.plans.state import fit_feature_state
from orderlens.session import stage
from orderlens.sources.driver_views import order_tables
from orderlens.streaming.raw import (PLACED, STATE_ROWS, STREAMS, base_stream, land, land_later_order, score_raw_stream, stamped, state_partitions,
                                     write_stream)


@pytest.fixture(scope="module")
def setup(spark):
    tables = order_tables(spark, SF_SMALL)
    rows = {name: stage(df, f"raw-{name}") for name, df in stamped(tables).items()}
    return tables, rows, {name: rows[name].schema for name in STREAMS}


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_restart_gives_each_finished_order_once(spark, setup, tmp_path):
    tables, rows, schemas = setup
    state = fit_feature_state(tables, response_mean=False)
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = base_stream(spark, source, schemas, tables["products"], state, delay="10 days", files_per_trigger=1)
        write_stream(stream, out, checkpoint).awaitTermination()
        return spark.read.parquet(out)

    land(rows, source, 0, 2, 4)
    first = run()
    early = {r["order_id"] for r in first.collect()}
    last = rows["orders"].agg(F.min(PLACED), F.max(PLACED)).first()
    half = last[0] + (last[1] - last[0]) / 2
    placed = {r["order_id"]: r[PLACED] for r in rows["orders"].collect()}
    assert early and all(placed[i] < half for i in early)                  # what is not finished yet is held back
    land(rows, source, 2, 4, 4)
    land_later_order(rows, source, days=400)
    final = run()
    want = catalog.f22_holdout_base(spark, SF_SMALL)
    assert rows_of(final) == rows_of(want) and early <= {r["order_id"] for r in want.collect()}
    assert rows_of(run()) == rows_of(want)                                 # nothing new: nothing written again


def test_late_rows_do_not_reopen_an_order(spark, setup, tmp_path):
    tables, rows, schemas = setup
    state = fit_feature_state(tables, response_mean=False)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    land(rows, source, 0, 1, 1)
    land_later_order(rows, source, days=400)

    def run():
        write_stream(base_stream(spark, source, schemas, tables["products"], state), out, checkpoint).awaitTermination()
        return rows_of(spark.read.parquet(out))

    before = run()
    rows["order_items"].limit(50).write.mode("append").parquet(f"{source}/order_items")
    assert run() == before


def test_scores_equal_the_batch(spark, setup, tmp_path):
    tables, rows, schemas = setup
    fitted = fit_scorer(tables, kind="lr")
    source = str(tmp_path / "in")
    land(rows, source, 0, 1, 1)
    land_later_order(rows, source, days=400)
    score_raw_stream(spark, fitted, source, schemas, tables["products"], str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = {r["order_id"]: r["prediction"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    holdout = {k: v for k, v in tables.items() if k != "order_reviews"}
    assert got == {r["order_id"]: r["prediction"] for r in score_tables(fitted, holdout).collect()}


def test_state_partitions_follow_cores_and_rows_not_the_session(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(catalog, "_new_folder", lambda *_: str(tmp_path / "raw"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = catalog.r5_stream_base(spark, SF_SMALL)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"      # the session stays as it is
        assert state_partitions(spark, 5 * STATE_ROWS + 1) == 6 and state_partitions(spark, 1000 * STATE_ROWS) == 24
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = [x for x in (tmp_path / "raw" / "checkpoint" / "state" / "0").iterdir() if x.name.isdigit()]
    assert len(stores) == spark.sparkContext.defaultParallelism < 24
    assert rows_of(got) == rows_of(catalog.f22_holdout_base(spark, SF_SMALL))


def test_slices_of_many_files_lose_no_order(spark, monkeypatch, tmp_path):
    day = [datetime(1995, 1, 1) + timedelta(days=(k * 37) % 2400) for k in range(300)]
    made = {"orders": ([(k, k, "F", day[k]) for k in range(300)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
            "lineitem": ([(k, n, (k + n) % 20 + 1, 10.0 + k, 0.1, 5.0 + n, "ANR"[n]) for k in range(300) for n in range(3)],
                         "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_tax double, l_quantity double, l_returnflag string"),
            "part": ([(k, f"type {k % 5}", k % 12 + 1, 100.0 + k) for k in range(1, 21)], "p_partkey long, p_type string, p_size int, p_retailprice double"),
            "events": ([(k, "purchase", 3.0, day[k]) for k in range(300)], "event_id long, event_type string, value double, ts timestamp")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/sf/{name}.parquet")
    monkeypatch.setattr(catalog, "_new_folder", lambda *_: str(tmp_path / "raw"))
    many = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false",    # as tables of many files are read
            "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in many}
    for k, v in many.items():
        spark.conf.set(k, v)
    try:
        got = rows_of(catalog.r5_stream_base(spark, f"{tmp_path}/sf"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "raw" / "order_items").glob("*.parquet"))) > 3 * 8       # over two triggers of four a slice
    want = rows_of(catalog.f22_holdout_base(spark, f"{tmp_path}/sf"))
    assert got == want and len(want) > 200
    assert [x.name for x in (tmp_path / "raw" / "checkpoint" / "state").iterdir() if x.name.isdigit()] == ["0"]      # one state for all


def test_odd_rows_give_the_batch_base(spark, tmp_path):
    at = datetime(2020, 1, 1)
    days = [at + timedelta(days=k) for k in range(9)]
    order = "order_id long, order_status string, order_purchase_timestamp timestamp, order_approved_at timestamp, " \
            "order_delivered_carrier_date timestamp, order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp"
    orders = [(k, "delivered", at, days[1], days[2], days[3 + k % 4], days[5]) for k in range(8)]
    orders += [orders[0], (*orders[1][:5], days[8], days[5]), (None, *orders[2][1:])]       # an equal row, another row of an order, no order
    items = [(k, n, k % 3 + n, None if k == 3 else 1.1 * n, 0.1 * k + n) for k in range(7) for n in (1, 2, 2)]
    payments = [(0, 1, "b", 1, 0.1), (0, 1, "a", 2, 0.2), (1, None, "z", 1, 0.3), (1, 1, "a", 1, 0.7), (2, None, "z", 1, 5.0), (2, 2, "z", 1, 5.0),
                (2, 3, "voucher", 1, 1.0), (3, 1, "a", 1, 1.0), (4, 1, None, 3, 2.0), (4, 2, "mobile", 3, 2.0), (5, 1, "a", 0, 2.0), (6, 1, "credit_card", 1, 2.5),
                (6, None, None, 5, 2.5), (7, 1, "a", 1, 1.0)]
    tables = {"orders": spark.createDataFrame(orders, order),
              "order_items": spark.createDataFrame(items, "order_id long, order_item_id int, product_id long, price double, shipping_cost double"),
              "order_payments": spark.createDataFrame(payments, "order_id long, payment_sequential int, payment_type string, payment_installments int, payment_value double"),
              "products": spark.createDataFrame([(k, None if k == 1 else f"c{k % 2}", k, 100.0 * k, 1.0, 2.0, 3.0) for k in range(5)],
                                                "product_id long, product_category_name string, product_photos_qty int, product_weight_g double, "
                                                "product_length_cm double, product_height_cm double, product_width_cm double")}
    state = fit_feature_state(tables, response_mean=False)
    rows = {name: df.drop(PLACED) for name, df in stamped(tables).items()}
    rows = {name: df.withColumn(PLACED, F.lit(at)) for name, df in rows.items()}
    land(rows, str(tmp_path / "in"), 0, 1, 1)
    land_later_order(rows, str(tmp_path / "in"), days=400)
    stream = base_stream(spark, str(tmp_path / "in"), {name: rows[name].schema for name in STREAMS}, tables["products"], state)
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), partitions=2).awaitTermination()
    want = rows_of(build_base(tables, state))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == want and len(want) >= 5
