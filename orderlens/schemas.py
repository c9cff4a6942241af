"""Declared schemas of the five order tables.

The source CSVs carry a header row and write missing values as ``NA``; an
explicit schema plus ``nullValue="NA"`` replaces type inference (which costs a
full extra pass over each file and falls back to ``string`` on one ``NA``).
"""

from pyspark.sql import types as T

PRODUCTS = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_category_name", T.StringType()),
    T.StructField("product_photos_qty", T.IntegerType()),
    T.StructField("product_weight_g", T.DoubleType()),
    T.StructField("product_length_cm", T.DoubleType()),
    T.StructField("product_height_cm", T.DoubleType()),
    T.StructField("product_width_cm", T.DoubleType()),
])

ORDERS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_status", T.StringType()),
    T.StructField("order_purchase_timestamp", T.TimestampType()),
    T.StructField("order_approved_at", T.TimestampType()),
    T.StructField("order_delivered_carrier_date", T.TimestampType()),
    T.StructField("order_delivered_customer_date", T.TimestampType()),
    T.StructField("order_estimated_delivery_date", T.TimestampType()),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_item_id", T.IntegerType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("shipping_cost", T.DoubleType()),
])

ORDER_PAYMENTS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("payment_sequential", T.IntegerType()),
    T.StructField("payment_type", T.StringType()),
    T.StructField("payment_installments", T.IntegerType()),
    T.StructField("payment_value", T.DoubleType()),
])

ORDER_REVIEWS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("review_score", T.IntegerType()),
    T.StructField("review_creation_date", T.TimestampType()),
    T.StructField("review_answer_timestamp", T.TimestampType()),
])

TABLES = {
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
}
