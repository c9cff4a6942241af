"""R5 over the raw tables: base rows from the streams of orders, items and payments as orders finish.

The three streams are read with a watermark on ``placed_at``, the time the order was placed, which every row of an order
carries. They meet in one aggregate per order, the only state that is kept; an order is finished when the watermark passes its
``placed_at``, then it leaves the state and becomes one base row. State holds unfinished orders alone, on disk (RocksDB). Late
rows of an order that is finished are dropped by the watermark.

Products are a static table. The fitted state (shipping threshold) is that of the training tables, so the rows can go
straight into a fitted model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.expressions import fixed_sum, flag
from orderlens.ml.evaluation import positive_probability
from orderlens.ml.matrix import apply_matrix
from orderlens.operators.cleaning import drop_incomplete, filter_positive
from orderlens.plans.base import BASE_COLUMNS, KEY, ORDER_COLUMNS
from orderlens.plans.items import DECIMALS, ITEM_FEATURES, item_features
from orderlens.plans.orders import order_features
from orderlens.plans.payments import PAYMENT_FLAGS, payment_labels
from orderlens.plans.products import product_features
from orderlens.plans.state import FeatureState

#: Event time of every row: when its order was placed.
PLACED = "placed_at"
STREAMS = ("orders", "order_items", "order_payments")
#: Rows of state that one partition may hold before a stream gets more partitions than cores.
STATE_ROWS = 500_000
_PARTITIONS = "spark.sql.shuffle.partitions"
#: Disk-backed state with one bound on the memory of all stores of an executor, no space reserved for their logs, and no look-up of
#: each key before it is written or removed (that only counts the rows for the progress report).
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
          "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
          "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
_SUMS = {"total_price": "price", "total_shipping_cost": "shipping_cost", "order_weight": "product_weight_kg", "order_size": "product_vol_cm3"}


def stamped(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The three raw tables with ``placed_at`` on every row (rows of unknown orders have none and are left out)."""
    placed = tables["orders"].select(KEY, F.col("order_purchase_timestamp").cast("timestamp").alias(PLACED)).dropDuplicates([KEY])
    return {"orders": tables["orders"].withColumn(PLACED, F.col("order_purchase_timestamp").cast("timestamp")),
            **{name: tables[name].join(placed, KEY) for name in STREAMS[1:]}}


def _one_stream(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of all parts in one stream: the order, its time and, for each part, the row as a struct (null in rows of other parts)."""
    kinds = {name: T.StructType([f for f in df.schema.fields if f.name not in (KEY, PLACED)]) for name, df in parts.items()}
    return reduce(DataFrame.unionByName, [
        df.where(F.col(PLACED).isNotNull())
        .select(KEY, PLACED, *[F.struct(*kind.names).alias(k) if k == name else F.lit(None).cast(kind).alias(k) for k, kind in kinds.items()])
        for name, df in parts.items()])


def _order_state(rows: DataFrame) -> DataFrame:
    """One group per order: its distinct order rows, ``item_aggregates`` and ``payment_aggregates``.

    A distinct count is no streaming aggregate, so the few categories and payment types of an order are kept as sets. Rows are dealt out
    by order as they are: they are narrower than the aggregates, which then need no shuffle of their own.
    """
    payment_type, seq = F.col("payment.payment_type"), F.col("payment.payment_sequential")
    known = F.min(F.when(payment_type.isNotNull() & seq.isNotNull(), F.struct(seq.alias("o"), payment_type.alias("v"))))
    groups = rows.repartition(KEY, PLACED).groupBy(KEY, PLACED).agg(
        F.collect_set("order").alias("_orders"),
        F.count("item.order_item_id").alias("total_items"),
        *[F.round(fixed_sum(f"item.{c}"), DECIMALS).alias(total) for total, c in _SUMS.items()],
        F.collect_set("item.product_category_name").alias("_categories"),
        F.avg("item.product_photos_qty").alias("avg_photo_per_order"),
        F.round(fixed_sum("payment.payment_value"), 2).alias("total_payment_value"),
        F.collect_set(payment_type).alias("_types"),
        F.collect_set(F.when(seq.isNotNull(), payment_type)).alias("_numbered"),
        F.max(seq).alias("num_payment_sequential"),
        F.max("payment.payment_installments").alias("max_installments"),
        known.getField("v").alias("_first"))
    unnumbered = F.array_min(F.array_except("_types", "_numbered"))          # first_by puts types without any number first
    return groups.withColumns({
        "num_distinct_products_category": F.size("_categories").cast("long"),
        "average_item_price": F.try_divide(F.col("total_price"), F.col("total_items")),
        "num_payment_types": F.size("_types").cast("long"),
        "primary_payment_type": F.coalesce(unnumbered, F.col("_first")),
        **{name: flag(F.array_contains("_types", value)) for value, name in PAYMENT_FLAGS.items()}})


def base_stream(spark: SparkSession, source: str, schemas: dict[str, T.StructType], products: DataFrame, state: FeatureState,
                delay: str = "30 days", files_per_trigger: int | None = None) -> DataFrame:
    """The streaming base rows of the Parquet folders ``source/orders``, ``source/order_items`` and ``source/order_payments``:
    the columns of the holdout base, complete rows only, each finished order once.

    Files are taken in the order in which they came. The rows of a span of ``placed_at`` longer than ``delay`` may lie in several files
    in any order; ``files_per_trigger`` must then be no less than these files (``land`` returns their number), as the watermark passes
    a span one batch after the batch that read its last time, and what is left of it then would be late.
    """
    def read(name: str) -> DataFrame:
        reader = spark.readStream.schema(schemas[name])
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(f"{source}/{name}").withWatermark(PLACED, delay)

    raw = {name: read(name) for name in STREAMS}
    groups = _order_state(_one_stream({
        "order": order_features(raw["orders"], keep=(PLACED,)).select(*ORDER_COLUMNS, PLACED),
        "item": raw["order_items"].join(product_features(products), "product_id"),
        "payment": filter_positive(raw["order_payments"], "payment_installments")}))
    aggregates = ("_orders", *[c for c in groups.columns if c not in ITEM_FEATURES and not c.startswith("_")])
    items = item_features(groups, state.shipping_threshold, keep=aggregates)
    both = payment_labels(items, keep=(*ITEM_FEATURES[1:], "_orders"))
    joined = both.select("*", F.explode("_orders").alias("order")).select("*", "order.*")
    return drop_incomplete(joined.select(*BASE_COLUMNS))     # groups without items or without payments have null totals


def state_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for a stream whose state may hold ``rows`` rows: the cores, more where a partition would hold over
    ``STATE_ROWS``, and never more than the session's shuffle partitions."""
    return min(int(spark.conf.get(_PARTITIONS)), max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS)))


def write_stream(rows: DataFrame, out: str, checkpoint: str, available_now: bool = True, partitions: int | None = None):
    """Append the rows to Parquet; with the checkpoint a restarted stream goes on where it stopped, each row written once.

    ``partitions`` is the number of state partitions of a new checkpoint (one that exists keeps its own); without it the session's
    shuffle partitions. Each of the stream's stateful operators writes a file per partition and batch, however few rows it has.
    """
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    conf = rows.sparkSession.conf
    settings = {**_STATE, **({_PARTITIONS: str(partitions)} if partitions else {})}
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        return writer.start(out)                             # takes its own copy of the session's settings
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def score_raw_stream(spark: SparkSession, fitted, source: str, schemas: dict[str, T.StructType], products: DataFrame, out: str,
                     checkpoint: str, delay: str = "30 days", available_now: bool = True):
    """Score every order as it finishes, from the raw streams: ``order_id, prediction, score`` appended to ``out``."""
    base = base_stream(spark, source, schemas, products, fitted.state, delay)
    scored = fitted.model.transform(apply_matrix(fitted.matrix, base)).select(KEY, "prediction", positive_probability().alias("score"))
    return write_stream(scored, out, checkpoint, available_now)


def land(tables: dict[str, DataFrame], source: str, begin: int, end: int, of: int) -> int:
    """Append the slices ``begin`` to ``end`` - 1 of ``of`` equal spans of ``placed_at`` to the source folders, oldest first; returns
    the most files that a slice has in one folder."""
    span = tables["orders"].agg(F.min(PLACED).alias("lo"), F.max(PLACED).alias("hi")).first()
    step = (span["hi"] - span["lo"]) / of
    most, landed = 0, dict.fromkeys(STREAMS, 0)
    for k in range(begin, end):
        for name in STREAMS:
            at = F.col(PLACED)
            low = at >= F.lit(span["lo"] + k * step) if k else F.lit(True)
            high = at < F.lit(span["lo"] + (k + 1) * step) if k + 1 < of else F.lit(True)
            tables[name].where(low & high).write.mode("append").parquet(f"{source}/{name}")
            files = len(tables[name].sparkSession.read.schema(tables[name].schema).parquet(f"{source}/{name}").inputFiles())
            most, landed[name] = max(most, files - landed[name]), files
    return most


def land_later_order(tables: dict[str, DataFrame], source: str, days: int) -> None:
    """One order placed ``days`` after all others, so that these are finished; itself it stays open."""
    spark = tables["orders"].sparkSession
    last = tables["orders"].agg(F.expr(f"max({PLACED}) + interval {days} days")).first()[0]
    known = {KEY: -1, PLACED: last, "order_status": "delivered", "payment_installments": 1, "product_id": 0}
    for name in STREAMS:
        schema = tables[name].schema
        row = tuple(known.get(f.name) if f.name != KEY or not isinstance(f.dataType, T.StringType) else "-1" for f in schema.fields)
        spark.createDataFrame([row], T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])) \
            .write.mode("append").parquet(f"{source}/{name}")
