"""Feature builders on tiny hand-written tables (FIXTURES.md unit fixtures)."""

from datetime import datetime

import pytest

from orderlens import schemas
from orderlens.plans.items import item_aggregates, item_features
from orderlens.plans.orders import order_features
from orderlens.plans.payments import payment_features
from orderlens.plans.products import product_features
from orderlens.plans.reviews import latest_reviews, response_times, review_features


def ts(s):
    return datetime.fromisoformat(s)


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_orders_rules(spark):
    base = ts("2018-03-10 23:30:00")
    rows = [
        # id, status, purchase, approved, carrier, delivered, estimated
        ("a", "delivered", base, ts("2018-03-11 00:10:00"), ts("2018-03-12 08:00:00"),
         ts("2018-03-20 09:00:00"), ts("2018-03-19 00:00:00")),                   # delay 1, midnight crossing
        ("b", "delivered", base, base, base, ts("2018-03-19 10:00:00"), ts("2018-03-19 00:00:00")),  # delay 0
        ("c", "delivered", base, base, base, ts("2018-03-18 23:59:59"), ts("2018-03-19 00:00:00")),  # delay -1
        ("d", "delivered", base, base, base, None, ts("2018-03-19 00:00:00")),   # null delivered
        ("e", "shipped", base, base, base, base, base),                         # not delivered
        ("NA", "delivered", base, base, base, base, base),                      # sentinel id
        (None, "delivered", base, base, base, base, base),                      # null id
        ("f", "delivered", None, base, base, base, base),                       # null purchase date
    ]
    df = spark.createDataFrame(rows, schemas.ORDERS)
    out = rows_by(order_features(df), "order_id")
    assert set(out) == {"a", "b", "c", "d", "f"}
    a = out["a"]
    assert (a["approval_time"], a["carrier_delivery_time"], a["customer_delivery_time"]) == (1, 1, 8)
    assert (a["delivery_delay"], a["late_delivery_flag"], a["delivery_days"]) == (1, 1, 10)
    assert (out["b"]["delivery_delay"], out["b"]["late_delivery_flag"]) == (0, 0)
    assert (out["c"]["delivery_delay"], out["c"]["late_delivery_flag"]) == (-1, 0)
    assert out["d"]["delivery_delay"] is None and out["d"]["late_delivery_flag"] == 0
    assert out["f"]["purchase_month"] is None and out["f"]["purchase_season"] == "Fall"
    assert a["purchase_month"] == 3 and a["purchase_year"] == 2018 and a["purchase_season"] == "Spring"


def test_season_every_month(spark):
    rows = [(f"o{m}", "delivered", datetime(2017, m, 15), None, None, None, None) for m in range(1, 13)]
    out = rows_by(order_features(spark.createDataFrame(rows, schemas.ORDERS)), "order_id")
    want = {12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring",
            6: "Summer", 7: "Summer", 8: "Summer", 9: "Fall", 10: "Fall", 11: "Fall"}
    for m, season in want.items():
        assert out[f"o{m}"]["purchase_season"] == season


def test_products(spark):
    rows = [("p1", "toys", 2, 1500.0, 10.0, 1.5, 3.333),     # volume needing rounding
            ("p2", None, None, 250.0, None, 2.0, 2.0),        # null dimension, null photos
            ]
    out = rows_by(product_features(spark.createDataFrame(rows, schemas.PRODUCTS)), "product_id")
    assert out["p1"]["product_vol_cm3"] == 50.0 and out["p1"]["product_weight_kg"] == 1.5
    assert out["p2"]["product_vol_cm3"] is None and out["p2"]["product_photos_qty"] is None


def _items(spark):
    products = spark.createDataFrame([
        ("p1", "toys", 2, 1000.0, 1.0, 1.0, 1.0),
        ("p2", "toys", 5, 2000.0, 2.0, 1.0, 1.0),
        ("p3", None, 6, 500.0, 1.0, 1.0, 1.0),
        ("p4", "home", None, 100.0, 1.0, 1.0, 1.0),
    ], schemas.PRODUCTS)
    items = spark.createDataFrame([
        ("o1", 1, "p1", 10.0, 1.0), ("o1", 2, "p1", 20.0, 2.0), ("o1", 3, "p2", 30.0, 3.0),  # one category
        ("o2", 1, "p3", 5.0, 100.0),                                  # null category, photos 6 -> High
        ("o3", 1, "p4", 7.0, 0.5),                                    # all photos null -> High
        ("o4", 1, "p2", 1.0, 0.1),                                    # photo average exactly 5
        ("o5", 1, "p1", 1.0, 0.1),                                    # photo average exactly 2
        ("o6", 1, "missing", 1.0, 0.1),                               # product with no match
    ], schemas.ORDER_ITEMS)
    return item_aggregates(items, product_features(products))


def test_items(spark):
    aggs = _items(spark)
    out = rows_by(item_features(aggs, shipping_threshold=6.0), "order_id")
    assert "o6" not in out
    o1 = out["o1"]
    assert (o1["total_items"], o1["total_price"], o1["total_shipping_cost"]) == (3, 60.0, 6.0)
    assert o1["num_distinct_products_category"] == 1 and o1["average_item_price"] == 20.0
    assert o1["order_weight"] == 4.0 and o1["order_size"] == 4.0
    assert o1["high_shipping_cost_flag"] == 0                  # 6.0 is not above 6.0
    assert out["o2"]["high_shipping_cost_flag"] == 1
    assert out["o2"]["num_distinct_products_category"] == 0
    assert out["o2"]["photo_per_order_category"] == "High"
    assert out["o3"]["photo_per_order_category"] == "High"
    assert out["o4"]["photo_per_order_category"] == "Medium"
    assert out["o5"]["photo_per_order_category"] == "Low"


def test_payments(spark):
    rows = [
        ("o1", 1, "credit_card", 1, 10.005), ("o1", 2, "voucher", 2, 5.0),      # paid two ways
        ("o2", 1, None, 3, 1.0), ("o2", 2, "mobile", 3, 2.0),                   # null type first
        ("o3", 1, "debit_card", 4, 1.0), ("o3", 2, "debit_card", 4, 1.0),
        ("o3", 3, "debit_card", 4, 1.0), ("o3", 4, "debit_card", 4, 1.0),
        ("o4", 1, "voucher", 0, 100.0),                                         # only zero installments
    ]
    out = rows_by(payment_features(spark.createDataFrame(rows, schemas.ORDER_PAYMENTS)), "order_id")
    assert set(out) == {"o1", "o2", "o3"}
    o1, o2, o3 = out["o1"], out["o2"], out["o3"]
    assert o1["primary_payment_type"] == "credit_card" and o1["num_payment_types"] == 2
    assert o1["multiple_payment_type_flag"] == 1 and o1["total_payment_value"] == 15.01
    assert (o1["in_credit_card"], o1["in_voucher"], o1["in_mobile"]) == (1, 1, 0)
    assert o1["installment_category"] == "Short-Term" and o1["payment_complexity_category"] == "Moderate"
    assert o2["primary_payment_type"] == "mobile" and o2["num_payment_types"] == 1
    assert o2["installment_category"] == "Short-Term"
    assert o3["installment_category"] == "Long-Term" and o3["payment_complexity_category"] == "Complex"
    assert o3["multiple_payment_type_flag"] == 0


@pytest.mark.parametrize("inst,label", [(1, "One-Time"), (2, "Short-Term"), (3, "Short-Term"), (4, "Long-Term")])
def test_installment_edges(spark, inst, label):
    df = spark.createDataFrame([("o", 1, "voucher", inst, 1.0)], schemas.ORDER_PAYMENTS)
    assert payment_features(df).first()["installment_category"] == label


def test_reviews(spark):
    rows = [
        ("o1", 5, ts("2018-01-01 10:00:00"), ts("2018-01-03 10:00:00")),
        ("o1", 2, ts("2018-01-01 10:00:00"), ts("2018-01-05 10:00:00")),   # later answer wins
        ("o2", 4, ts("2018-01-01 10:00:00"), None),                          # unanswered loses
        ("o2", 1, ts("2018-01-01 10:00:00"), ts("2018-01-02 09:00:00")),
        ("o3", 3, ts("2018-01-02 00:00:00"), ts("2018-01-04 00:00:00")),    # tie on answer time:
        ("o3", 4, ts("2018-01-03 00:00:00"), ts("2018-01-04 00:00:00")),    # later creation wins
        ("o4", None, ts("2018-01-01 00:00:00"), ts("2018-01-02 00:00:00")),  # null score dropped
        ("o5", 4, ts("2018-01-01 00:00:00"), None),                          # only unanswered
    ]
    df = spark.createDataFrame(rows, schemas.ORDER_REVIEWS)
    out = rows_by(review_features(df), "order_id")
    assert set(out) == {"o1", "o2", "o3", "o5"}
    assert (out["o1"]["review_score"], out["o1"]["review_positive_flag"]) == (2, 0)
    assert out["o2"]["review_score"] == 1
    assert (out["o3"]["review_score"], out["o3"]["review_positive_flag"]) == (4, 1)
    rt = rows_by(response_times(latest_reviews(df)), "order_id")
    # observed times 4, 1, 1 -> mean 2.0; o5 is imputed; int column keeps the truncated mean
    assert rt["o1"]["review_response_time"] == 4
    assert rt["o5"]["review_response_time"] == 2


def test_response_mean_truncates(spark):
    rows = [("a", 5, ts("2018-01-01 00:00:00"), ts("2018-01-04 00:00:00")),   # 3
            ("b", 5, ts("2018-01-01 00:00:00"), ts("2018-01-03 00:00:00")),   # 2
            ("c", 5, ts("2018-01-01 00:00:00"), ts("2018-01-04 00:00:00")),   # 3 -> mean 2.67
            ("d", 5, ts("2018-01-01 00:00:00"), None)]
    df = spark.createDataFrame(rows, schemas.ORDER_REVIEWS)
    rt = rows_by(response_times(latest_reviews(df)), "order_id")
    assert rt["d"]["review_response_time"] == 2
    assert rt["d"]["review_response_time"] == int(8 / 3)
    fitted = rows_by(response_times(latest_reviews(df), mean=5.9), "order_id")
    assert fitted["d"]["review_response_time"] == 5


def test_primary_type_tie_and_sums_across_levels(spark):
    rows = [("o1", 2, "voucher", 1, 0.1), ("o1", 2, "credit_card", 1, 0.2),     # tie on lowest seq
            ("o1", 3, "voucher", 1, 0.3), ("o1", 1, None, 1, 0.4),              # null type at seq 1
            ("o2", 5, "mobile", 2, 1.005), ("o2", 5, "mobile", 2, 1.0)]
    out = rows_by(payment_features(spark.createDataFrame(rows, schemas.ORDER_PAYMENTS)), "order_id")
    assert out["o1"]["primary_payment_type"] == "credit_card"
    assert out["o1"]["total_payment_value"] == 1.0 and out["o1"]["num_payment_types"] == 2
    assert out["o1"]["num_payment_sequential"] == 3
    assert out["o2"]["total_payment_value"] == 2.01 and out["o2"]["num_payment_types"] == 1
