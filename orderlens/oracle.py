"""DuckDB SQL for the SQL-checkable queries of ``orderlens.catalog``.

The driver registers its Parquet tables as views (``part``, ``orders``,
``lineitem``, ``events``, ``labels`` ...). The CTEs below rebuild the order
tables and every feature step in plain SQL, independently of the Spark code.
Dialect notes: ``date_diff('day', start, end)`` is Spark's
``datediff(end, start)``; a double is truncated with ``trunc`` before an
integer cast (DuckDB rounds, Spark truncates); sums of doubles are DuckDB's
compensated ones, rounded as a whole.
"""

from __future__ import annotations

VIEWS = """
v_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_partkey % 17 <> 0 THEN p_type END AS product_category_name,
         CAST(CASE WHEN p_size <> 13 THEN p_size % 8 END AS INTEGER) AS product_photos_qty,
         p_retailprice AS product_weight_g,
         CAST(p_size AS DOUBLE) AS product_length_cm,
         CAST(p_size % 7 + 1 AS DOUBLE) AS product_height_cm,
         CAST(p_size % 5 + 1 AS DOUBLE) AS product_width_cm
  FROM part),
v_orders_dates AS (
  SELECT o_orderkey AS order_id, o_orderstatus, o_custkey, o_orderdate,
         o_orderdate + to_days(CAST(o_orderkey % 3 AS INTEGER)) AS approved
  FROM orders),
v_orders AS (
  SELECT order_id,
         CASE WHEN o_orderstatus = 'F' THEN 'delivered' ELSE o_orderstatus END AS order_status,
         o_orderdate AS order_purchase_timestamp,
         approved AS order_approved_at,
         approved + to_days(CAST(order_id % 5 AS INTEGER)) AS order_delivered_carrier_date,
         CASE WHEN order_id % 50 <> 0
              THEN approved + to_days(CAST(order_id % 5 AS INTEGER)) + to_days(CAST(o_custkey % 40 AS INTEGER))
         END AS order_delivered_customer_date,
         o_orderdate + to_days(CAST(20 + order_id % 11 AS INTEGER)) AS order_estimated_delivery_date
  FROM v_orders_dates),
v_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_extendedprice AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(12,2)) AS DOUBLE) AS shipping_cost
  FROM lineitem),
v_payments AS (
  SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
         CASE WHEN l_quantity > 45 THEN 'mobile'
              WHEN l_returnflag = 'A' THEN 'credit_card'
              WHEN l_returnflag = 'N' THEN 'voucher'
              WHEN l_returnflag = 'R' THEN 'debit_card' END AS payment_type,
         CAST(trunc(l_quantity) AS INTEGER) % 6 AS payment_installments,
         l_extendedprice AS payment_value
  FROM lineitem),
v_reviews AS (
  SELECT event_id // 2 AS order_id,
         CAST(CAST(floor(value) AS BIGINT) % 5 + 1 AS INTEGER) AS review_score,
         ts AS review_creation_date,
         CASE WHEN event_id % 10 <> 0 THEN ts + to_days(CAST(event_id % 7 AS INTEGER)) END
           AS review_answer_timestamp
  FROM events),
v_scored_events AS (
  SELECT event_id AS row_id, CAST(event_type = 'purchase' AS DOUBLE) AS label, value AS score,
         CAST(value > 50 AS DOUBLE) AS prediction
  FROM events),
v_scored_labels AS (
  SELECT doc_id AS row_id, CAST(quality AS DOUBLE) AS label, CAST(toxic AS DOUBLE) AS prediction
  FROM labels)
"""

FEATURES = """
f_products AS (
  SELECT product_id, product_category_name,
         round(product_length_cm * product_height_cm * product_width_cm, 2) AS product_vol_cm3,
         product_weight_g / 1000 AS product_weight_kg,
         product_photos_qty
  FROM v_products),
f_orders_base AS (
  SELECT order_id,
         CAST(date_diff('day', order_purchase_timestamp, order_approved_at) AS INTEGER) AS approval_time,
         CAST(date_diff('day', order_approved_at, order_delivered_carrier_date) AS INTEGER) AS carrier_delivery_time,
         CAST(date_diff('day', order_delivered_carrier_date, order_delivered_customer_date) AS INTEGER)
           AS customer_delivery_time,
         CAST(date_diff('day', order_estimated_delivery_date, order_delivered_customer_date) AS INTEGER)
           AS delivery_delay,
         CAST(date_diff('day', order_purchase_timestamp, order_delivered_customer_date) AS INTEGER) AS delivery_days,
         CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month,
         CAST(year(order_purchase_timestamp) AS INTEGER) AS purchase_year
  FROM v_orders
  WHERE order_id IS NOT NULL AND order_status = 'delivered'),
f_orders AS (
  SELECT order_id, approval_time, carrier_delivery_time, customer_delivery_time, delivery_delay,
         CASE WHEN delivery_delay > 0 THEN 1 ELSE 0 END AS late_delivery_flag,
         delivery_days, purchase_month, purchase_year,
         CASE WHEN purchase_month IN (12, 1, 2) THEN 'Winter'
              WHEN purchase_month IN (3, 4, 5) THEN 'Spring'
              WHEN purchase_month IN (6, 7, 8) THEN 'Summer'
              ELSE 'Fall' END AS purchase_season
  FROM f_orders_base),
f_item_sums AS (
  SELECT i.order_id,
         count(i.order_item_id) AS total_items,
         round(fsum(i.price), 6) AS total_price,
         round(fsum(i.shipping_cost), 6) AS total_shipping_cost,
         round(fsum(p.product_weight_kg), 6) AS order_weight,
         round(fsum(p.product_vol_cm3), 6) AS order_size,
         count(DISTINCT p.product_category_name) AS num_distinct_products_category,
         avg(p.product_photos_qty) AS avg_photo_per_order
  FROM v_items i JOIN f_products p ON i.product_id = p.product_id
  GROUP BY i.order_id),
f_item_aggs AS (
  SELECT *, total_price / total_items AS average_item_price FROM f_item_sums),
f_threshold AS (
  SELECT quantile_disc(total_shipping_cost, 0.9) AS shipping_threshold FROM f_item_aggs),
f_items AS (
  SELECT order_id, total_items, total_price, total_shipping_cost, order_weight, order_size,
         num_distinct_products_category, average_item_price,
         CASE WHEN total_shipping_cost > (SELECT shipping_threshold FROM f_threshold) THEN 1 ELSE 0 END
           AS high_shipping_cost_flag,
         CASE WHEN avg_photo_per_order <= 2 THEN 'Low'
              WHEN avg_photo_per_order > 2 AND avg_photo_per_order <= 5 THEN 'Medium'
              ELSE 'High' END AS photo_per_order_category
  FROM f_item_aggs),
f_pay_aggs AS (
  SELECT order_id,
         round(fsum(payment_value), 2) AS total_payment_value,
         count(DISTINCT payment_type) AS num_payment_types,
         max(payment_sequential) AS num_payment_sequential,
         max(payment_installments) AS max_installments,
         (min({'o': payment_sequential, 'v': payment_type}) FILTER (WHERE payment_type IS NOT NULL)).v
           AS primary_payment_type,
         max(CASE WHEN payment_type = 'voucher' THEN 1 ELSE 0 END) AS in_voucher,
         max(CASE WHEN payment_type = 'credit_card' THEN 1 ELSE 0 END) AS in_credit_card,
         max(CASE WHEN payment_type = 'mobile' THEN 1 ELSE 0 END) AS in_mobile,
         max(CASE WHEN payment_type = 'debit_card' THEN 1 ELSE 0 END) AS in_debit_card
  FROM v_payments WHERE payment_installments > 0
  GROUP BY order_id),
f_payments AS (
  SELECT order_id, num_payment_types, primary_payment_type,
         CASE WHEN num_payment_types > 1 THEN 1 ELSE 0 END AS multiple_payment_type_flag,
         num_payment_sequential, total_payment_value, max_installments,
         CASE WHEN max_installments = 1 THEN 'One-Time'
              WHEN max_installments > 1 AND max_installments <= 3 THEN 'Short-Term'
              ELSE 'Long-Term' END AS installment_category,
         CASE WHEN num_payment_sequential = 1 THEN 'Simple'
              WHEN num_payment_sequential BETWEEN 2 AND 3 THEN 'Moderate'
              ELSE 'Complex' END AS payment_complexity_category,
         in_credit_card, in_voucher, in_mobile
  FROM f_pay_aggs),
f_latest AS (
  SELECT order_id, review_creation_date, review_answer_timestamp, review_score,
         CASE WHEN review_score >= 4 THEN 1 ELSE 0 END AS review_positive_flag
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id
                     ORDER BY review_answer_timestamp DESC NULLS LAST, review_creation_date DESC NULLS LAST,
                              review_score DESC NULLS LAST) AS rn
        FROM v_reviews WHERE review_score IS NOT NULL)
  WHERE rn = 1),
f_reviews AS (
  SELECT order_id, review_score, review_positive_flag FROM f_latest),
f_base_left AS (
  SELECT DISTINCT o.order_id, o.approval_time, o.carrier_delivery_time, o.customer_delivery_time,
         o.delivery_delay, o.late_delivery_flag, o.delivery_days,
         p.num_payment_types, p.primary_payment_type, p.multiple_payment_type_flag, p.num_payment_sequential,
         p.total_payment_value, p.max_installments, p.installment_category, p.payment_complexity_category,
         p.in_credit_card, p.in_voucher, p.in_mobile,
         i.total_items, i.total_price, i.total_shipping_cost, i.order_weight, i.order_size,
         i.num_distinct_products_category, i.average_item_price, i.high_shipping_cost_flag,
         i.photo_per_order_category, r.review_positive_flag
  FROM f_orders o
  LEFT JOIN f_payments p ON o.order_id = p.order_id
  JOIN f_items i ON o.order_id = i.order_id
  JOIN f_reviews r ON o.order_id = r.order_id),
f_base AS (
  SELECT * FROM f_base_left
  WHERE COLUMNS(*) IS NOT NULL)
"""

BASE_COLS = """order_id, approval_time, carrier_delivery_time, customer_delivery_time, delivery_delay,
  late_delivery_flag, delivery_days, num_payment_types, primary_payment_type, multiple_payment_type_flag,
  num_payment_sequential, total_payment_value, max_installments, installment_category,
  payment_complexity_category, in_credit_card, in_voucher, in_mobile, total_items, total_price,
  total_shipping_cost, order_weight, order_size, num_distinct_products_category, average_item_price,
  high_shipping_cost_flag, photo_per_order_category"""


def _with(body: str) -> str:
    return f"WITH {VIEWS.strip()},\n{FEATURES.strip()}\n{body.strip()}"


def _split_bucket(key: str) -> str:
    return f"CAST(('0x' || substr(md5('123:' || CAST({key} AS VARCHAR)), 1, 8))::UBIGINT % 100 AS INTEGER)"


_CUM = """
g AS (SELECT score, count(*) FILTER (WHERE label = 1.0) AS pos, count(*) FILTER (WHERE label <> 1.0) AS neg
      FROM v_scored_events GROUP BY score),
c AS (SELECT score, pos, neg, pos + neg AS rows,
             CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS cum_pos,
             CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS cum_neg,
             CAST(sum(pos + neg) OVER (ORDER BY score DESC) AS BIGINT) AS cum_rows
      FROM g),
t AS (SELECT sum(pos) AS total_pos, sum(neg) AS total_neg, sum(pos + neg) AS total_rows FROM g)
"""

_DESCRIBE_COLS = ["order_id", "approval_time", "carrier_delivery_time", "customer_delivery_time", "delivery_delay",
                  "late_delivery_flag", "delivery_days", "purchase_month", "purchase_year"]

_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
       round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS stddev, min(CAST({c} AS DOUBLE)) AS min,
       max(CAST({c} AS DOUBLE)) AS max, CAST(min({c}) AS VARCHAR) AS min_exact, CAST(max({c}) AS VARCHAR) AS max_exact
       FROM f_orders""" for c in _DESCRIBE_COLS)

# Columns of the order-table views: (all columns, numeric columns).
_VIEW_COLUMNS = {
    "v_products": (["product_id", "product_category_name", "product_photos_qty", "product_weight_g",
                    "product_length_cm", "product_height_cm", "product_width_cm"],
                   ["product_id", "product_photos_qty", "product_weight_g", "product_length_cm",
                    "product_height_cm", "product_width_cm"]),
    "v_orders": (["order_id", "order_status", "order_purchase_timestamp", "order_approved_at",
                  "order_delivered_carrier_date", "order_delivered_customer_date",
                  "order_estimated_delivery_date"], ["order_id"]),
    "v_items": (["order_id", "order_item_id", "product_id", "price", "shipping_cost"],
                ["order_id", "order_item_id", "product_id", "price", "shipping_cost"]),
    "v_payments": (["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"],
                   ["order_id", "payment_sequential", "payment_installments", "payment_value"]),
    "v_reviews": (["order_id", "review_score", "review_creation_date", "review_answer_timestamp"],
                  ["order_id", "review_score"]),
}


def _describe_sql(view: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
           round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS stddev, min(CAST({c} AS DOUBLE)) AS min,
           max(CAST({c} AS DOUBLE)) AS max, CASE WHEN typeof(any_value({c})) NOT IN ('DOUBLE', 'FLOAT') THEN CAST(min({c}) AS VARCHAR) END AS min_exact,
           CASE WHEN typeof(any_value({c})) NOT IN ('DOUBLE', 'FLOAT') THEN CAST(max({c}) AS VARCHAR) END AS max_exact FROM {view}"""
        for c in _VIEW_COLUMNS[view][1])


def _describe_text_sql(view: str, *columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS count, min({c}) AS min, max({c}) AS max FROM {view}" for c in columns)


def _null_counts_sql(view: str) -> str:
    return "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}"
                                 for c in _VIEW_COLUMNS[view][0]) + f" FROM {view}"


_NULL_LONG = " UNION ALL ".join(
    f"SELECT count(*) FILTER (WHERE {c} IS NULL) AS null_count, '{c}' AS column_name FROM f_base_left"
    for c in [x.strip() for x in BASE_COLS.split(",")] + ["review_positive_flag"])


def _outcome(col: str) -> str:
    return _with(f"""SELECT {col}, count(*) AS orders, avg(CAST(review_positive_flag AS DOUBLE)) AS positive_rate
                    FROM f_base GROUP BY {col} ORDER BY {col}""")


def _infer_sql() -> str:
    """Cells of every column that fit each type, by patterns and ``try_cast``, and the narrowest type that all fit."""
    out = []
    for view, (columns, _) in _VIEW_COLUMNS.items():
        table = {"v_products": "products", "v_orders": "orders", "v_items": "order_items", "v_payments": "order_payments",
                 "v_reviews": "order_reviews"}[view]
        for k, c in enumerate(columns):
            out.append(f"""
              SELECT '{table}' AS table_name, CAST({k} AS INTEGER) AS position, '{c}' AS column_name, count(s) AS cells,
                     count(*) FILTER (WHERE lower(s) IN ('true', 'false')) AS booleans,
                     count(*) FILTER (WHERE regexp_full_match(s, '[+-]?[0-9]+') AND TRY_CAST(s AS BIGINT) IS NOT NULL) AS bigints,
                     count(*) FILTER (WHERE TRY_CAST(s AS DOUBLE) IS NOT NULL) AS doubles,
                     count(*) FILTER (WHERE TRY_CAST(s AS DOUBLE) IS NULL AND TRY_CAST(s AS TIMESTAMP) IS NOT NULL) AS timestamps
              FROM (SELECT CAST({c} AS VARCHAR) AS s FROM {view})""")
    return f""", counts AS ({" UNION ALL ".join(out)})
        SELECT *, CASE WHEN cells = 0 THEN 'text' WHEN booleans = cells THEN 'boolean' WHEN bigints = cells THEN 'bigint'
                       WHEN doubles = cells THEN 'double' WHEN timestamps = cells THEN 'timestamp' ELSE 'text' END AS type
        FROM counts"""


_NUMBERS = ["approval_time", "carrier_delivery_time", "customer_delivery_time", "delivery_delay", "late_delivery_flag", "delivery_days",
            "num_payment_types", "multiple_payment_type_flag", "num_payment_sequential", "total_payment_value", "max_installments",
            "in_credit_card", "in_voucher", "in_mobile", "total_items", "total_price", "total_shipping_cost", "order_weight", "order_size",
            "num_distinct_products_category", "average_item_price", "high_shipping_cost_flag"]
_TEXTS = ["primary_payment_type", "installment_category", "payment_complexity_category", "photo_per_order_category"]
_FACTORS = [c.strip() for c in BASE_COLS.split(",")][1:]


def _matrix_sql() -> str:
    """One row per base order and filled slot: columns in base order, text levels by frequency on the training part."""
    levels = " UNION ALL ".join(f"""SELECT '{c}' AS name, level, row_number() OVER (ORDER BY n DESC, level) - 1 AS rank, count(*) OVER () AS levels
                                   FROM (SELECT {c} AS level, count(*) AS n FROM tr WHERE {c} IS NOT NULL GROUP BY {c})""" for c in _TEXTS)
    widths = " UNION ALL ".join(
        f"SELECT {k} AS place, '{c}' AS name, " + (f"(SELECT CASE WHEN count(*) < 2 THEN 0 ELSE count(*) - 1 END FROM lv WHERE name = '{c}')" if c in _TEXTS else "1")
        + " AS width" for k, c in enumerate(_FACTORS))
    cells = " UNION ALL ".join(
        f"""SELECT b.order_id, CAST(f.first + l.rank AS INTEGER) AS slot, CAST(1 AS DOUBLE) AS value FROM base b JOIN lv l ON l.name = '{c}' AND l.level = b.{c}
            JOIN firsts f ON f.name = '{c}' WHERE l.rank < l.levels - 1""" if c in _TEXTS else
        f"SELECT b.order_id, CAST(f.first AS INTEGER) AS slot, CAST(b.{c} AS DOUBLE) AS value FROM base b JOIN firsts f ON f.name = '{c}' WHERE b.{c} <> 0" for c in _FACTORS)
    return _with(f"""
        , tr AS (SELECT * FROM f_base WHERE {_split_bucket('order_id')} < 80),
        base AS (SELECT * REPLACE (CASE WHEN order_id % 11 = 0 THEN 'unseen' ELSE primary_payment_type END AS primary_payment_type) FROM f_base),
        lv AS ({levels}),
        w AS ({widths}),
        firsts AS (SELECT name, sum(width) OVER (ORDER BY place) - width AS first FROM w)
        {cells}""")


def _factors_sql() -> str:
    edges = ", ".join(str(k / 10) for k in range(1, 10))
    pairs = " UNION ALL ".join(
        f"SELECT '{c}' AS factor, {c} AS level, review_positive_flag AS y FROM f_base" if c in _TEXTS else
        f"""SELECT '{c}' AS factor, CAST(len(list_filter(list_distinct((SELECT quantile_disc(CAST({c} AS DOUBLE), [{edges}]) FROM f_base)), lambda e: e < {c})) AS VARCHAR) AS level,
                   review_positive_flag AS y FROM f_base""" for c in _FACTORS)
    h = "CASE WHEN {p} > 0 AND {p} < {n} THEN -({p} / {n}) * log2({p} / {n}) - (1 - {p} / {n}) * log2(1 - {p} / {n}) ELSE 0 END"
    return _with(f"""
        , pairs AS ({pairs}),
        cells AS (SELECT factor, level, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS pos FROM pairs GROUP BY factor, level),
        sums AS (SELECT factor, count(*) AS levels, sum(n) AS n, sum(pos) AS pos, sum(n * ({h.format(p='pos', n='n')})) AS rest FROM cells GROUP BY factor),
        gains AS (SELECT factor, levels, CAST(n AS BIGINT) AS orders, round(greatest(0, ({h.format(p='pos', n='n')}) - rest / n), 9) AS information_gain FROM sums)
        SELECT *, CAST(row_number() OVER (ORDER BY information_gain DESC, factor) AS INTEGER) AS rank FROM gains""")


ORACLE: dict[str, str] = {
    "x_season_delivery": _with("""
        SELECT purchase_season, count(*) AS orders, avg(late_delivery_flag) AS late_rate,
               avg(delivery_delay) AS avg_delay_days
        FROM f_orders GROUP BY purchase_season ORDER BY purchase_season"""),
    "s1_read_orders": _with("SELECT * FROM v_orders"),
    "s2_read_items": _with("SELECT * FROM v_items"),
    "s2_read_payments": _with("SELECT * FROM v_payments"),
    "s2_read_products": _with("SELECT * FROM v_products"),
    "s2_read_reviews": _with("SELECT * FROM v_reviews"),
    "s4_preview_orders": _with("SELECT * FROM v_orders ORDER BY order_id LIMIT 5"),
    "p1_describe_order_features": _with(_DESCRIBE),
    "p1_describe_products": _with(_describe_sql("v_products")),
    "p1_describe_items": _with(_describe_sql("v_items")),
    "p1_describe_payments": _with(_describe_sql("v_payments")),
    "p1_describe_reviews": _with(_describe_sql("v_reviews")),
    "p1_describe_text_products": _with(_describe_text_sql("v_products", "product_category_name")),
    "p1_describe_text_orders": _with(_describe_text_sql("v_orders", "order_status")),
    "p1_describe_text_payments": _with(_describe_text_sql("f_payments", "primary_payment_type", "installment_category", "payment_complexity_category")),
    "p2_null_counts_orders": _with(_null_counts_sql("v_orders")),
    "p2_null_counts_items": _with(_null_counts_sql("v_items")),
    "p2_null_counts_payments": _with(_null_counts_sql("v_payments")),
    "p2_null_counts_reviews": _with(_null_counts_sql("v_reviews")),
    "p2_null_counts_products": _with("""
        SELECT count(*) FILTER (WHERE product_id IS NULL) AS product_id,
               count(*) FILTER (WHERE product_category_name IS NULL) AS product_category_name,
               count(*) FILTER (WHERE product_photos_qty IS NULL) AS product_photos_qty,
               count(*) FILTER (WHERE product_weight_g IS NULL) AS product_weight_g,
               count(*) FILTER (WHERE product_length_cm IS NULL) AS product_length_cm,
               count(*) FILTER (WHERE product_height_cm IS NULL) AS product_height_cm,
               count(*) FILTER (WHERE product_width_cm IS NULL) AS product_width_cm
        FROM v_products"""),
    "p3_null_counts_long_base": _with(_NULL_LONG),
    "p4_value_counts_photos": _with("""
        SELECT product_photos_qty, count(*) AS count FROM v_products
        GROUP BY product_photos_qty ORDER BY product_photos_qty NULLS FIRST"""),
    "p4_value_counts_status": _with("""
        SELECT order_status, count(*) AS count FROM v_orders GROUP BY order_status ORDER BY order_status"""),
    "p5_row_counts": _with("""
        SELECT 'products' AS table_name, count(*) AS row_count FROM v_products
        UNION ALL SELECT 'orders', count(*) FROM v_orders
        UNION ALL SELECT 'order_items', count(*) FROM v_items
        UNION ALL SELECT 'order_payments', count(*) FROM v_payments
        UNION ALL SELECT 'order_reviews', count(*) FROM v_reviews"""),
    "p6_duplicate_count_payments": _with("""
        SELECT CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS duplicate_count
        FROM (SELECT count(*) AS copies FROM v_payments GROUP BY order_id, payment_sequential)"""),
    "p6_duplicate_count_base": _with(f"""
        SELECT CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS duplicate_count
        FROM (SELECT count(*) AS copies FROM f_base GROUP BY ALL_COLS)""".replace(
        "ALL_COLS", BASE_COLS + ", review_positive_flag")),
    "c1_drop_empty_rows": _with(f"""
        , gaps AS (SELECT {", ".join(f"CASE WHEN product_id % 23 <> 0 THEN {c} END AS {c}" for c in _VIEW_COLUMNS["v_products"][0])} FROM v_products)
        SELECT * FROM gaps WHERE NOT ({" AND ".join(f"{c} IS NULL" for c in _VIEW_COLUMNS["v_products"][0])})"""),
    "c2_drop_sentinel": _with("""
        SELECT order_id, order_status FROM (
          SELECT CASE WHEN order_id % 97 = 0 THEN 'NA' ELSE CAST(order_id AS VARCHAR) END AS order_id,
                 order_status FROM v_orders)
        WHERE order_id <> 'NA'"""),
    "c3_filter_status": _with("""
        SELECT order_id, order_status, order_purchase_timestamp FROM v_orders WHERE order_status = 'delivered'"""),
    "c4_filter_positive": _with("SELECT * FROM v_payments WHERE payment_installments > 0"),
    "c5_require": _with("SELECT * FROM v_reviews WHERE review_answer_timestamp IS NOT NULL"),
    "c6_dedupe": _with("SELECT DISTINCT order_id, payment_type FROM v_payments"),
    "c7_drop_incomplete": _with("SELECT * FROM v_products WHERE COLUMNS(*) IS NOT NULL"),
    "c8_impute_mean": _with("""
        SELECT product_id, coalesce(product_photos_qty,
                 CAST(trunc((SELECT avg(product_photos_qty) FROM v_products)) AS INTEGER)) AS product_photos_qty
        FROM v_products"""),
    "f1_product_features": _with("SELECT * FROM f_products"),
    "f2_delivery_intervals": _with("""
        SELECT order_id,
         CAST(date_diff('day', order_purchase_timestamp, order_approved_at) AS INTEGER) AS approval_time,
         CAST(date_diff('day', order_approved_at, order_delivered_carrier_date) AS INTEGER) AS carrier_delivery_time,
         CAST(date_diff('day', order_delivered_carrier_date, order_delivered_customer_date) AS INTEGER)
           AS customer_delivery_time,
         CAST(date_diff('day', order_estimated_delivery_date, order_delivered_customer_date) AS INTEGER)
           AS delivery_delay,
         CAST(date_diff('day', order_purchase_timestamp, order_delivered_customer_date) AS INTEGER) AS delivery_days
        FROM v_orders"""),
    "f3_late_flag": _with("SELECT order_id, delivery_delay, late_delivery_flag FROM f_orders"),
    "f4_calendar_parts": _with("SELECT order_id, purchase_month, purchase_year FROM f_orders"),
    "f5_season": _with("SELECT order_id, purchase_month, purchase_season FROM f_orders"),
    "f6_order_features": _with("SELECT * FROM f_orders"),
    "f7_item_aggregates": _with("SELECT * FROM f_item_aggs"),
    "f9_shipping_threshold": _with("SELECT shipping_threshold FROM f_threshold"),
    "f10_item_features": _with("SELECT * FROM f_items"),
    "f11_photo_bucket": _with("""
        SELECT order_id, avg_photo_per_order,
               CASE WHEN avg_photo_per_order <= 2 THEN 'Low'
                    WHEN avg_photo_per_order > 2 AND avg_photo_per_order <= 5 THEN 'Medium'
                    ELSE 'High' END AS photo_per_order_category
        FROM f_item_aggs"""),
    "f12_payment_aggregates": _with("SELECT * FROM f_pay_aggs"),
    "f16_payment_features": _with("SELECT * FROM f_payments"),
    "f17_latest_review": _with("SELECT * FROM f_latest"),
    "f19_response_time": _with("""
        , rt AS (SELECT order_id, CAST(date_diff('day', review_creation_date, review_answer_timestamp) AS INTEGER)
                   AS review_response_time FROM f_latest)
        SELECT order_id, coalesce(review_response_time,
                 CAST(trunc((SELECT avg(review_response_time) FROM rt)) AS INTEGER)) AS review_response_time
        FROM rt"""),
    "f20_review_features": _with("SELECT * FROM f_reviews"),
    "f21_base_table": _with("SELECT * FROM f_base"),
    "f21_base_table_left": _with("SELECT * FROM f_base_left"),
    "f22_holdout_base": _with(f"""
        SELECT DISTINCT o.order_id, o.approval_time, o.carrier_delivery_time, o.customer_delivery_time,
               o.delivery_delay, o.late_delivery_flag, o.delivery_days, p.* EXCLUDE (order_id),
               i.* EXCLUDE (order_id)
        FROM f_orders o JOIN f_payments p ON o.order_id = p.order_id JOIN f_items i ON o.order_id = i.order_id
        WHERE COLUMNS(*) IS NOT NULL"""),
    "f23_year_category": _with(f"""
        SELECT DISTINCT b.*, CAST(o.purchase_year AS VARCHAR) AS purchase_year_cat
        FROM f_base_left b JOIN f_orders o ON b.order_id = o.order_id
        WHERE COLUMNS(*) IS NOT NULL"""),
    "j1_items_products": _with("""
        SELECT i.order_id, i.order_item_id, i.product_id, i.price, p.product_category_name, p.product_vol_cm3
        FROM v_items i JOIN f_products p ON i.product_id = p.product_id"""),
    "j2_orders_payments_left": _with("""
        SELECT o.order_id, o.delivery_delay, p.total_payment_value, p.primary_payment_type
        FROM f_orders o LEFT JOIN f_payments p ON o.order_id = p.order_id"""),
    "j3_orders_items_inner": _with("""
        SELECT o.order_id, o.delivery_days, i.total_items, i.high_shipping_cost_flag
        FROM f_orders o JOIN f_items i ON o.order_id = i.order_id"""),
    "o3_top_orders": _with("""
        SELECT order_id, total_price, total_items FROM f_item_aggs
        ORDER BY total_price DESC, order_id ASC LIMIT 20"""),
    "w2_running_positives": _with(f", {_CUM.strip()}\nSELECT score, cum_pos, cum_rows FROM c"),
    "m2_split": _with(f"""
        SELECT order_id, CASE WHEN {_split_bucket('order_id')} < 80 THEN 'train' ELSE 'validation' END AS split
        FROM f_base"""),
    "e1_accuracy_events": _with("""
        SELECT avg(CAST(label = prediction AS DOUBLE)) AS accuracy, count(*) AS n FROM v_scored_events"""),
    "e1_accuracy_labels": _with("""
        SELECT avg(CAST(label = prediction AS DOUBLE)) AS accuracy, count(*) AS n FROM v_scored_labels"""),
    "e2_confusion_events": _with("""
        SELECT label, count(*) FILTER (WHERE prediction = 0.0) AS "0.0",
               count(*) FILTER (WHERE prediction = 1.0) AS "1.0"
        FROM v_scored_events GROUP BY label ORDER BY label"""),
    "e2_confusion_labels": _with("""
        SELECT label, count(*) FILTER (WHERE prediction = 0.0) AS "0.0",
               count(*) FILTER (WHERE prediction = 1.0) AS "1.0"
        FROM v_scored_labels GROUP BY label ORDER BY label"""),
    "e3_roc_points": _with(f""", {_CUM.strip()}
        SELECT score AS threshold, cum_pos AS tp, cum_neg AS fp,
               cum_pos / total_pos AS tpr, cum_neg / total_neg AS fpr
        FROM c, t
        UNION ALL
        SELECT NULL, 0, 0, 0 / total_pos, 0 / total_neg FROM t WHERE EXISTS (SELECT 1 FROM c)"""),
    "e4_auc": _with(f""", {_CUM.strip()}
        SELECT CAST(sum(CAST(neg AS HUGEINT) * (2 * (cum_pos - pos) + pos)) AS DOUBLE)
               / (2.0 * CAST(max(total_pos) AS DOUBLE) * CAST(max(total_neg) AS DOUBLE)) AS auc
        FROM c, t"""),
    "e5_gains": _with(f""", {_CUM.strip()}
        SELECT score AS threshold, cum_rows / total_rows AS fraction, cum_pos / total_pos AS gain,
               (cum_pos / total_pos) / (cum_rows / total_rows) AS lift
        FROM c, t"""),
    "r2_cap_outliers": _with("""
        , b AS (SELECT quantile_disc(total_shipping_cost, 0.01) AS lo,
                       quantile_disc(total_shipping_cost, 0.99) AS hi FROM f_item_aggs)
        SELECT order_id, least(greatest(total_shipping_cost, lo), hi) AS total_shipping_cost
        FROM f_item_aggs, b"""),
    "r4_class_weights": _with("""
        , k AS (SELECT review_positive_flag, count(*) AS n FROM f_base GROUP BY review_positive_flag),
        w AS (SELECT review_positive_flag, (SELECT sum(n) FROM k) / ((SELECT count(*) FROM k) * n) AS weight FROM k)
        SELECT order_id, review_positive_flag, weight FROM f_base JOIN w USING (review_positive_flag)"""),
    "r6_outcome_by_delay": _outcome("late_delivery_flag"),
    "r6_outcome_by_delay_days": _outcome("delivery_delay"),
    "r6_outcome_by_shipping": _outcome("high_shipping_cost_flag"),
    "r6_outcome_by_items": _outcome("total_items"),
    "r6_outcome_by_voucher": _outcome("in_voucher"),
    "p6_duplicate_count_products": _with(f"""
        SELECT CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS duplicate_count
        FROM (SELECT count(*) AS copies FROM v_products GROUP BY {", ".join(_VIEW_COLUMNS["v_products"][0][1:])})"""),
    "c6_dedupe_orders": _with("SELECT DISTINCT * FROM (SELECT * FROM v_orders UNION ALL SELECT * FROM v_orders WHERE order_id % 3 = 0)"),
    "s1_infer_types": _with(_infer_sql()),
    "e3_roc_corners": _with(f""", {_CUM.strip()},
        k AS (SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, lag(score) OVER w AS above FROM c WINDOW w AS (ORDER BY score DESC))
        SELECT score AS threshold, cum_pos AS tp, cum_neg AS fp, cum_pos / total_pos AS tpr, cum_neg / total_neg AS fpr
        FROM k, t WHERE above IS NULL OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
        UNION ALL
        SELECT NULL, 0, 0, 0 / total_pos, 0 / total_neg FROM t WHERE EXISTS (SELECT 1 FROM c)"""),
    "m1_matrix_slots": _matrix_sql(),
    "r5_stream_base": _with(f"""
        SELECT DISTINCT o.order_id, o.approval_time, o.carrier_delivery_time, o.customer_delivery_time,
               o.delivery_delay, o.late_delivery_flag, o.delivery_days, p.* EXCLUDE (order_id), i.* EXCLUDE (order_id)
        FROM f_orders o JOIN f_payments p ON o.order_id = p.order_id JOIN f_items i ON o.order_id = i.order_id
        WHERE COLUMNS(*) IS NOT NULL"""),
    "a10_sketch_quantiles": _with(" UNION ALL ".join(f"""
        SELECT CAST({p} AS DOUBLE) AS p, count(*) AS n, CAST(floor((CAST({p} AS DOUBLE) - 0.05::DOUBLE) * count(*)) AS BIGINT) AS least_rank,
               CAST(ceil((CAST({p} AS DOUBLE) + 0.05::DOUBLE) * count(*)) AS BIGINT) AS greatest_rank, true AS within_bound FROM f_item_aggs"""
        for p in (0.1, 0.5, 0.9, 0.99))),
    "r4_stratified_sample": _with("""
        , h AS (SELECT order_id, review_positive_flag,
                       ('0x' || substr(md5('42:' || CAST(order_id AS VARCHAR)), 1, 15))::BIGINT AS draw FROM f_base),
        least_n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM f_base GROUP BY review_positive_flag))
        SELECT order_id, review_positive_flag FROM (
          SELECT *, row_number() OVER (PARTITION BY review_positive_flag ORDER BY draw, order_id) AS place FROM h), least_n
        WHERE place <= n"""),
    "r6_rank_factors": _factors_sql(),
    "r2_cap_by_category": _with("""
        , j AS (SELECT i.order_id, i.order_item_id, p.product_category_name, i.price FROM v_items i JOIN f_products p ON i.product_id = p.product_id),
        b AS (SELECT product_category_name, quantile_disc(price, 0.05) AS low, quantile_disc(price, 0.95) AS high FROM j GROUP BY product_category_name)
        SELECT j.order_id, j.order_item_id, j.product_category_name, least(greatest(j.price, b.low), b.high) AS price
        FROM j JOIN b ON j.product_category_name IS NOT DISTINCT FROM b.product_category_name"""),
}
