"""

Each takes ``(spark, sf_dir)``, reads the driver's Parquet tables through the
order-table views, and returns a DataFrame. ``orderlens.oracle`` holds the
DuckDB SQL for every query that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.ml import evaluation as ev
from orderlens.ml.matrix import apply_matrix, fit_matrix, split
from orderlens.ml.models import (coefficients, feature_importance, fit_model, make_estimator,
                                 prediction_counts, predictions, score)
from orderlens.ml.tuning import best_params, grid, tune
from orderlens.operators import cleaning as cl
from orderlens.operators import quality as q
from orderlens.operators.cumulative import running_totals
from orderlens.operators.quantile import quantile_row
from orderlens.operators.ranking import top_k
from orderlens.plans.base import KEY, LABEL, base_table, build_base
from orderlens.plans.insights import outcome_by, season_delivery_summary
from orderlens.plans.items import SHIPPING_QUANTILE, fit_shipping_threshold, item_aggregates, item_features
from orderlens.plans.orders import delivery_intervals, order_features
from orderlens.plans.payments import payment_aggregates, payment_features
from orderlens.plans.products import product_features
from orderlens.plans.reviews import latest_reviews, response_times, review_features
from orderlens.plans.state import fit_feature_state
from orderlens.session import stage
from orderlens.sources import driver_views as dv
from orderlens.sources.sinks import preview

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- helpers

def _tables(spark, sf, with_reviews=True):
    return dv.order_tables(spark, sf, with_reviews)


def _item_aggs(spark, sf):
    """The per-order item aggregates, staged: the quantile and the base table both read them."""
    return stage(item_aggregates(dv.order_items_view(spark, sf), product_features(dv.products_view(spark, sf))), "item_aggregates")


def _item_f(spark, sf):
    aggs = _item_aggs(spark, sf)
    return item_features(aggs, fit_shipping_threshold(aggs))


def _base(spark, sf, complete_only=True, with_reviews=True):
    tables = _tables(spark, sf)
    aggs = _item_aggs(spark, sf)
    state = fit_feature_state(tables, item_aggs=aggs, response_mean=False)
    if not with_reviews:
        tables = {k: v for k, v in tables.items() if k != "order_reviews"}
    return build_base(tables, state, complete_only=complete_only, item_aggs=aggs)


def _matrix_split(spark, sf):
    """Staged base table -> hash split -> formula fitted on the training part."""
    from orderlens.fitting import fit_base, fit_matrix_split
    _, base = fit_base(_tables(spark, sf))
    return fit_matrix_split(base)


def _scored(spark, sf, kind, **params):
    _, tr, va = _matrix_split(spark, sf)
    model = fit_model(kind, tr, **params)
    return model, tr, score(model, va)


def _curve_input(scored):
    return scored.select("label", ev.positive_probability().alias("score"), "prediction")


# ---------------------------------------------------------------- sources / sinks

def _new_folder(spark, name):
    import uuid

    from orderlens.session import work_root
    return f"{work_root(spark).rstrip('/')}/orderlens/{name}-{uuid.uuid4().hex}"


def _write_csv(spark, df, name):
    from orderlens.sources.tables import NA
    path, micros = _new_folder(spark, f"csv-{name}"), "yyyy-MM-dd HH:mm:ss.SSSSSS"
    df.write.options(header="true", nullValue=NA, timestampFormat=micros, timestampNTZFormat=micros).csv(path)
    return path


def _read_back_csv(spark, sf, name):
    """The view written as CSV (columns reversed, one more column) and read by its header names."""
    from orderlens.sources.tables import read_table
    view = _tables(spark, sf)[name]
    return read_table(spark, _write_csv(spark, view.select(F.lit("x").alias("further"), *reversed(view.columns)), name), view.schema)


def s1_infer_types(spark, sf):
    """All five tables written as CSV and read without a schema: the counts behind each inferred type."""
    from orderlens.sources.inference import infer_types, raw_cells
    parts = [infer_types(raw_cells(spark, _write_csv(spark, view, name))).select(F.lit(name).alias("table_name"), "*")
             for name, view in _tables(spark, sf).items()]
    return reduce(DataFrame.unionByName, parts)


def s1_read_orders(spark, sf):
    return _read_back_csv(spark, sf, "orders")


def s2_read_items(spark, sf):
    return _read_back_csv(spark, sf, "order_items")


def s2_read_payments(spark, sf):
    return _read_back_csv(spark, sf, "order_payments")


def s2_read_products(spark, sf):
    return _read_back_csv(spark, sf, "products")


def s2_read_reviews(spark, sf):
    return _read_back_csv(spark, sf, "order_reviews")


def s4_preview_orders(spark, sf):
    return preview(dv.orders_view(spark, sf), 5, ["order_id"])


# ---------------------------------------------------------------- profiling

def p1_describe_order_features(spark, sf):
    return q.describe_table(order_features(dv.orders_view(spark, sf)), digits=6)


def p1_describe_products(spark, sf):
    return q.describe_table(dv.products_view(spark, sf), digits=6)


def p1_describe_items(spark, sf):
    return q.describe_table(dv.order_items_view(spark, sf), digits=6)


def p1_describe_payments(spark, sf):
    return q.describe_table(dv.order_payments_view(spark, sf), digits=6)


def p1_describe_reviews(spark, sf):
    return q.describe_table(dv.order_reviews_view(spark, sf), digits=6)


def p1_describe_text_products(spark, sf):
    return q.describe_text(dv.products_view(spark, sf))


def p1_describe_text_orders(spark, sf):
    return q.describe_text(dv.orders_view(spark, sf))


def p1_describe_text_payments(spark, sf):
    return q.describe_text(payment_features(dv.order_payments_view(spark, sf)))


def p2_null_counts_orders(spark, sf):
    return q.null_counts(dv.orders_view(spark, sf))


def p2_null_counts_items(spark, sf):
    return q.null_counts(dv.order_items_view(spark, sf))


def p2_null_counts_payments(spark, sf):
    return q.null_counts(dv.order_payments_view(spark, sf))


def p2_null_counts_reviews(spark, sf):
    return q.null_counts(dv.order_reviews_view(spark, sf))


def p2_null_counts_products(spark, sf):
    return q.null_counts(dv.products_view(spark, sf))


def p3_null_counts_long_base(spark, sf):
    return q.null_counts_long(_base(spark, sf, complete_only=False))


def p4_value_counts_photos(spark, sf):
    return q.value_counts(dv.products_view(spark, sf), "product_photos_qty")


def p4_value_counts_status(spark, sf):
    return q.value_counts(dv.orders_view(spark, sf), "order_status")


def p5_row_counts(spark, sf):
    return q.row_counts(_tables(spark, sf))


def p6_duplicate_count_payments(spark, sf):
    return q.duplicate_count(dv.order_payments_view(spark, sf), ["order_id", "payment_sequential"])


def p6_duplicate_count_products(spark, sf):
    """Products that are equal in all but their id."""
    return q.duplicate_count(dv.products_view(spark, sf).drop("product_id"))


def p6_duplicate_count_base(spark, sf):
    return q.duplicate_count(_base(spark, sf))


# ---------------------------------------------------------------- cleaning

def c1_drop_empty_rows(spark, sf):
    """Whole rows: every 23rd product has lost all its values."""
    p = dv.products_view(spark, sf)
    return cl.drop_empty_rows(p.select(*[F.when(F.col("product_id") % 23 != 0, F.col(c)).alias(c) for c in p.columns]))


def c2_drop_sentinel(spark, sf):
    o = dv.orders_view(spark, sf)
    text_id = F.when(F.col("order_id") % 97 == 0, F.lit("NA")).otherwise(F.col("order_id").cast("string"))
    return cl.drop_sentinel(o.select(text_id.alias("order_id"), "order_status"), "order_id")


def c3_filter_status(spark, sf):
    return cl.filter_status(dv.orders_view(spark, sf), "order_status", "delivered") \
             .select("order_id", "order_status", "order_purchase_timestamp")


def c4_filter_positive(spark, sf):
    return cl.filter_positive(dv.order_payments_view(spark, sf), "payment_installments")


def c5_require(spark, sf):
    return cl.require(dv.order_reviews_view(spark, sf), "review_answer_timestamp")


def c6_dedupe(spark, sf):
    return cl.dedupe(dv.order_payments_view(spark, sf).select("order_id", "payment_type"))


def c6_dedupe_orders(spark, sf):
    """Whole rows: a third of the orders arrive twice."""
    o = dv.orders_view(spark, sf)
    return cl.dedupe(o.unionByName(o.where(F.col("order_id") % 3 == 0)))


def c7_drop_incomplete(spark, sf):
    return cl.drop_incomplete(dv.products_view(spark, sf))


def c8_impute_mean(spark, sf):
    return cl.impute_mean(dv.products_view(spark, sf).select("product_id", "product_photos_qty"),
                          "product_photos_qty")


# ---------------------------------------------------------------- features

def f1_product_features(spark, sf):
    return product_features(dv.products_view(spark, sf))


def f2_delivery_intervals(spark, sf):
    o = dv.orders_view(spark, sf)
    return o.select("order_id", *[v.alias(k) for k, v in delivery_intervals(o).items()])


def f3_late_flag(spark, sf):
    return order_features(dv.orders_view(spark, sf)).select("order_id", "delivery_delay", "late_delivery_flag")


def f4_calendar_parts(spark, sf):
    return order_features(dv.orders_view(spark, sf)).select("order_id", "purchase_month", "purchase_year")


def f5_season(spark, sf):
    return order_features(dv.orders_view(spark, sf)).select("order_id", "purchase_month", "purchase_season")


def f6_order_features(spark, sf):
    return order_features(dv.orders_view(spark, sf))


def f7_item_aggregates(spark, sf):
    return item_aggregates(dv.order_items_view(spark, sf), product_features(dv.products_view(spark, sf)))


def f9_shipping_threshold(spark, sf):
    return quantile_row(f7_item_aggregates(spark, sf), "total_shipping_cost", [SHIPPING_QUANTILE]) \
        .select(F.col("q0").alias("shipping_threshold"))


def f10_item_features(spark, sf):
    return _item_f(spark, sf)


def f11_photo_bucket(spark, sf):
    from orderlens.functions.expressions import photo_bucket
    return f7_item_aggregates(spark, sf).select(
        "order_id", "avg_photo_per_order", photo_bucket("avg_photo_per_order").alias("photo_per_order_category"))


def f12_payment_aggregates(spark, sf):
    return payment_aggregates(dv.order_payments_view(spark, sf))


def f16_payment_features(spark, sf):
    return payment_features(dv.order_payments_view(spark, sf))


def f17_latest_review(spark, sf):
    return latest_reviews(dv.order_reviews_view(spark, sf))


def f19_response_time(spark, sf):
    return response_times(latest_reviews(dv.order_reviews_view(spark, sf))) \
        .select("order_id", "review_response_time")


def f20_review_features(spark, sf):
    return review_features(dv.order_reviews_view(spark, sf))


def f21_base_table(spark, sf):
    return _base(spark, sf)


def f21_base_table_left(spark, sf):
    return _base(spark, sf, complete_only=False)


def f22_holdout_base(spark, sf):
    return _base(spark, sf, with_reviews=False)


def f23_year_category(spark, sf):
    tables = _tables(spark, sf)
    return base_table(order_features(tables["orders"]), payment_features(tables["order_payments"]),
                      _item_f(spark, sf), review_features(tables["order_reviews"]), with_year_category=True)


# ---------------------------------------------------------------- joins, sort, limit

def j1_items_products(spark, sf):
    return dv.order_items_view(spark, sf).join(product_features(dv.products_view(spark, sf)),
                                                "product_id", "inner") \
        .select("order_id", "order_item_id", "product_id", "price", "product_category_name", "product_vol_cm3")


def j2_orders_payments_left(spark, sf):
    return order_features(dv.orders_view(spark, sf)).join(
        payment_features(dv.order_payments_view(spark, sf)), "order_id", "left") \
        .select("order_id", "delivery_delay", "total_payment_value", "primary_payment_type")


def j3_orders_items_inner(spark, sf):
    return order_features(dv.orders_view(spark, sf)).join(_item_f(spark, sf), "order_id", "inner") \
        .select("order_id", "delivery_days", "total_items", "high_shipping_cost_flag")


def o3_top_orders(spark, sf):
    return top_k(f7_item_aggregates(spark, sf).select("order_id", "total_price", "total_items"), 20,
                 [F.col("total_price").desc(), F.col("order_id").asc()])


def w2_running_positives(spark, sf):
    counts = ev.score_counts(dv.scored_events(spark, sf))
    return running_totals(counts, "score", ["pos", "rows"], descending=True) \
        .select("score", "cum_pos", "cum_rows")


def m2_split(spark, sf):
    return split(_base(spark, sf), KEY).select(KEY, "split")


# ---------------------------------------------------------------- evaluation on given pairs

def e1_accuracy_events(spark, sf):
    return ev.accuracy(dv.scored_events(spark, sf))


def e1_accuracy_labels(spark, sf):
    return ev.accuracy(dv.scored_labels(spark, sf))


def e2_confusion_events(spark, sf):
    return ev.confusion_matrix(dv.scored_events(spark, sf))


def e2_confusion_labels(spark, sf):
    return ev.confusion_matrix(dv.scored_labels(spark, sf))


def e3_roc_points(spark, sf):
    return ev.roc_points(dv.scored_events(spark, sf))


def e3_roc_corners(spark, sf):
    return ev.roc_corners(dv.scored_events(spark, sf))


def e4_auc(spark, sf):
    return ev.auc(dv.scored_events(spark, sf))


def e5_gains(spark, sf):
    return ev.gains_curve(dv.scored_events(spark, sf))


# ---------------------------------------------------------------- README-only extras (SQL-checkable)

def r2_cap_outliers(spark, sf):
    from orderlens.ml.extras import cap_outliers, fit_caps
    aggs = stage(f7_item_aggregates(spark, sf).select("order_id", "total_shipping_cost"), "cap_input")
    caps = fit_caps(aggs, ["total_shipping_cost"], 0.01, 0.99)
    return cap_outliers(aggs, caps)


def r2_cap_by_category(spark, sf):
    """Item prices within the 5th and 95th percentile of their category."""
    from orderlens.ml.extras import cap_outliers_by, fit_caps_by
    items = stage(j1_items_products(spark, sf).select("order_id", "order_item_id", "product_category_name", "price"), "items_by_category")
    caps = fit_caps_by(items, "product_category_name", "price", 0.05, 0.95)
    return cap_outliers_by(items, caps, "product_category_name", "price")


def a10_sketch_quantiles(spark, sf):
    """Quantiles of the shipping totals from a sketch that took in three batches one after the other."""
    from orderlens.operators.sketch import QuantileSketch, rank_check
    aggs = stage(f7_item_aggregates(spark, sf).select("order_id", "total_shipping_cost"), "sketch_input")
    state = QuantileSketch()
    for batch in range(3):
        state = state.add(aggs.where(F.col("order_id") % 3 == batch), "total_shipping_cost")
    return rank_check(aggs, "total_shipping_cost", {p: state.quantile(spark, p) for p in (0.1, 0.5, 0.9, 0.99)})


def r4_stratified_sample(spark, sf):
    """As many orders of each outcome as the rarer one has."""
    from orderlens.ml.extras import stratified_sample
    base = stage(_base(spark, sf), "sample_base")
    return stratified_sample(base.select(KEY, LABEL), LABEL, KEY)


def r6_rank_factors(spark, sf):
    from orderlens.plans.insights import rank_factors
    return rank_factors(_base(spark, sf), LABEL, (KEY,))


def r5_stream_base(spark, sf):
    """The holdout base rows from three raw streams in time slices, one row per finished order."""
    from orderlens.streaming.raw import STREAMS, base_stream, land, land_later_order, stamped, state_partitions, write_stream
    tables, root = _tables(spark, sf), _new_folder(spark, "raw-stream")
    state = fit_feature_state(tables, response_mean=False)
    rows = {name: stage(df, f"stamped-{name}", rebalance=False) for name, df in stamped(tables).items()}
    slice_files = land(rows, root, 0, 3, 3)
    land_later_order(rows, root, days=400)
    stream = base_stream(spark, root, {name: rows[name].schema for name in STREAMS}, tables["products"], state,
                         files_per_trigger=max(4, slice_files))
    partitions = state_partitions(spark, max(df.count() for df in rows.values()))
    write_stream(stream, f"{root}/out", f"{root}/checkpoint", partitions=partitions).awaitTermination()
    return spark.read.parquet(f"{root}/out")


def r4_class_weights(spark, sf):
    from orderlens.ml.extras import class_weights
    return class_weights(stage(_base(spark, sf), "weights_base"), LABEL).select(KEY, LABEL, "weight")


def r6_outcome_by_delay(spark, sf):
    return outcome_by(_base(spark, sf), "late_delivery_flag")


def r6_outcome_by_delay_days(spark, sf):
    return outcome_by(_base(spark, sf), "delivery_delay")


def r6_outcome_by_shipping(spark, sf):
    return outcome_by(_base(spark, sf), "high_shipping_cost_flag")


def r6_outcome_by_items(spark, sf):
    return outcome_by(_base(spark, sf), "total_items")


def r6_outcome_by_voucher(spark, sf):
    return outcome_by(_base(spark, sf), "in_voucher")


def x_season_delivery(spark, sf):
    return season_delivery_summary(order_features(dv.orders_view(spark, sf)))


# ---------------------------------------------------------------- models (rows-only checks)

def m1_matrix(spark, sf):
    _, tr, va = _matrix_split(spark, sf)
    from pyspark.ml.functions import vector_to_array
    return tr.unionByName(va).select(KEY, "label", vector_to_array("features").alias("features"))


def m1_matrix_slots(spark, sf):
    """The filled slots of every order, layout fitted on the training part; every 11th order has a payment type never seen there."""
    from orderlens.ml.slots import apply_slots, fit_slots
    base = stage(_base(spark, sf), "slots_base")
    model = fit_slots(split(base, KEY).where("split = 'train'").drop("split"), LABEL, [KEY])
    unseen = base.withColumn("primary_payment_type", F.when(F.col(KEY) % 11 == 0, "unseen").otherwise(F.col("primary_payment_type")))
    return apply_slots(model, unseen, [KEY]).select(KEY, F.explode(F.arrays_zip("slots", "values")).alias("s")) \
        .select(KEY, F.col("s.slots").alias("slot"), F.col("s.values").alias("value"))


def m3_gradient(spark, sf):
    """The log-likelihood's gradient at the fitted logistic regression: 32 components near zero."""
    from orderlens.ml.models import log_likelihood_gradient
    _, tr, _ = _matrix_split(spark, sf)
    return log_likelihood_gradient(fit_model("lr", tr), tr)


def m3_lr_scores(spark, sf):
    _, _, scored = _scored(spark, sf, "lr")
    return scored.select(KEY, "label", ev.positive_probability().alias("score"), "prediction")


def m4_rf_scores(spark, sf):
    _, _, scored = _scored(spark, sf, "rf")
    return scored.select(KEY, "label", ev.positive_probability().alias("score"), "prediction")


def m5_gbt_scores(spark, sf):
    _, _, scored = _scored(spark, sf, "gbt")
    return scored.select(KEY, "label", ev.positive_probability().alias("score"), "prediction")


def m5_gbt_metrics(spark, sf):
    """Validation accuracy, exact AUC and the evaluator's binned AUC."""
    _, _, scored = _scored(spark, sf, "gbt")
    rep = ev.evaluation_report(_curve_input(scored))
    acc = rep["accuracy"].select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    area = rep["auc"].select(F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    binned = spark.range(1).select(F.lit("auc_binned_1000").alias("metric"),
                                   F.lit(ev.evaluator_auc(scored)).alias("value"))
    return acc.unionByName(area).unionByName(binned)


def m_compare_models(spark, sf):
    """README ranking: validation accuracy and exact AUC of GBT, LR and RF."""
    from orderlens.flow import model_metrics
    _, tr, va = _matrix_split(spark, sf)
    models = {k: fit_model(k, tr) for k in ("gbt", "lr", "rf")}
    return model_metrics(models, va)


def m7_cv_gbt(spark, sf):
    """The reference's 2x2x2 boosted-tree grid, 2 folds, accuracy; best parameters."""
    from orderlens.ml.tuning import GBT_GRID
    _, tr, _ = _matrix_split(spark, sf)
    est = make_estimator("gbt")
    cv = tune(est, grid(est, **GBT_GRID), tr, folds=2, parallelism=8)
    best = best_params(cv)
    rows = [(k, float(v)) for k, v in best.items()]
    return spark.createDataFrame(rows, "param string, value double")


def m7_fold_metrics(spark, sf):
    """The reference's grid: accuracy of each fold and grid point, and the means."""
    from orderlens.ml.tuning import GBT_GRID, fold_metrics
    _, tr, _ = _matrix_split(spark, sf)
    est = make_estimator("gbt")
    return fold_metrics(est, grid(est, **GBT_GRID), tr, folds=2, parallelism=8)


def m9_lr_coefficients(spark, sf):
    model, tr, _ = _scored(spark, sf, "lr")
    return coefficients(model, tr)


def m10_feature_importance(spark, sf):
    model, tr, _ = _scored(spark, sf, "gbt")
    return feature_importance(model, tr)


def m12_prediction_counts(spark, sf):
    _, _, scored = _scored(spark, sf, "gbt")
    return prediction_counts(scored)


def m12_holdout_predictions(spark, sf):
    """Train on the labelled tables, score the holdout base with the same state."""
    from orderlens.fitting import fit_scorer, score_tables
    tables = _tables(spark, sf)
    fitted = fit_scorer(tables, kind="gbt")
    holdout = {k: v for k, v in tables.items() if k != "order_reviews"}
    return predictions(score_tables(fitted, holdout))


def s3_write_predictions(spark, sf):
    """Score the holdout base and write ``(order_id, prediction)``; return what was written."""
    import uuid
    from orderlens.fitting import fit_scorer, score_tables
    from orderlens.session import work_root
    from orderlens.sources.sinks import write_predictions
    tables = _tables(spark, sf)
    fitted = fit_scorer(tables, kind="gbt")
    holdout = {k: v for k, v in tables.items() if k != "order_reviews"}
    path = f"{work_root(spark).rstrip('/')}/orderlens/predictions-{uuid.uuid4().hex}"
    write_predictions(predictions(score_tables(fitted, holdout)), path)
    return spark.read.parquet(path)


def r1_interactions(spark, sf):
    base = split(stage(_base(spark, sf), "interactions_base"), KEY)
    train = base.filter(F.col("split") == "train").drop("split")
    m = fit_matrix(train, LABEL, exclude=[KEY], interactions=[("delivery_delay", "total_shipping_cost")])
    from pyspark.ml.functions import vector_to_array
    return apply_matrix(m, train).select(KEY, vector_to_array("features").alias("features"))


def r3_stacking(spark, sf):
    from orderlens.ml.extras import apply_stack, fit_stack
    _, tr, va = _matrix_split(spark, sf)
    stack = fit_stack(tr, folds=2)
    return apply_stack(stack, va).select(KEY, "label", "prediction")


def r5_stream_scores(spark, sf):
    from orderlens.streaming.scoring import score_batch_dir
    return score_batch_dir(spark, sf)


SQL_CHECKED: dict[str, Query] = {
    "x_season_delivery": x_season_delivery,
    "s1_read_orders": s1_read_orders,
    "s2_read_items": s2_read_items,
    "s2_read_payments": s2_read_payments,
    "s2_read_products": s2_read_products,
    "s2_read_reviews": s2_read_reviews,
    "s4_preview_orders": s4_preview_orders,
    "p1_describe_order_features": p1_describe_order_features,
    "p1_describe_products": p1_describe_products,
    "p1_describe_items": p1_describe_items,
    "p1_describe_payments": p1_describe_payments,
    "p1_describe_reviews": p1_describe_reviews,
    "p1_describe_text_products": p1_describe_text_products,
    "p1_describe_text_orders": p1_describe_text_orders,
    "p1_describe_text_payments": p1_describe_text_payments,
    "p2_null_counts_orders": p2_null_counts_orders,
    "p2_null_counts_items": p2_null_counts_items,
    "p2_null_counts_payments": p2_null_counts_payments,
    "p2_null_counts_reviews": p2_null_counts_reviews,
    "p2_null_counts_products": p2_null_counts_products,
    "p3_null_counts_long_base": p3_null_counts_long_base,
    "p4_value_counts_photos": p4_value_counts_photos,
    "p4_value_counts_status": p4_value_counts_status,
    "p5_row_counts": p5_row_counts,
    "p6_duplicate_count_payments": p6_duplicate_count_payments,
    "p6_duplicate_count_base": p6_duplicate_count_base,
    "c1_drop_empty_rows": c1_drop_empty_rows,
    "c2_drop_sentinel": c2_drop_sentinel,
    "c3_filter_status": c3_filter_status,
    "c4_filter_positive": c4_filter_positive,
    "c5_require": c5_require,
    "c6_dedupe": c6_dedupe,
    "c7_drop_incomplete": c7_drop_incomplete,
    "c8_impute_mean": c8_impute_mean,
    "f1_product_features": f1_product_features,
    "f2_delivery_intervals": f2_delivery_intervals,
    "f3_late_flag": f3_late_flag,
    "f4_calendar_parts": f4_calendar_parts,
    "f5_season": f5_season,
    "f6_order_features": f6_order_features,
    "f7_item_aggregates": f7_item_aggregates,
    "f9_shipping_threshold": f9_shipping_threshold,
    "f10_item_features": f10_item_features,
    "f11_photo_bucket": f11_photo_bucket,
    "f12_payment_aggregates": f12_payment_aggregates,
    "f16_payment_features": f16_payment_features,
    "f17_latest_review": f17_latest_review,
    "f19_response_time": f19_response_time,
    "f20_review_features": f20_review_features,
    "f21_base_table": f21_base_table,
    "f21_base_table_left": f21_base_table_left,
    "f22_holdout_base": f22_holdout_base,
    "f23_year_category": f23_year_category,
    "j1_items_products": j1_items_products,
    "j2_orders_payments_left": j2_orders_payments_left,
    "j3_orders_items_inner": j3_orders_items_inner,
    "o3_top_orders": o3_top_orders,
    "w2_running_positives": w2_running_positives,
    "m2_split": m2_split,
    "e1_accuracy_events": e1_accuracy_events,
    "e1_accuracy_labels": e1_accuracy_labels,
    "e2_confusion_events": e2_confusion_events,
    "e2_confusion_labels": e2_confusion_labels,
    "e3_roc_points": e3_roc_points,
    "e4_auc": e4_auc,
    "e5_gains": e5_gains,
    "r2_cap_outliers": r2_cap_outliers,
    "r4_class_weights": r4_class_weights,
    "r6_outcome_by_delay": r6_outcome_by_delay,
    "r6_outcome_by_delay_days": r6_outcome_by_delay_days,
    "r6_outcome_by_shipping": r6_outcome_by_shipping,
    "r6_outcome_by_items": r6_outcome_by_items,
    "r6_outcome_by_voucher": r6_outcome_by_voucher,
    "s1_infer_types": s1_infer_types,
    "p6_duplicate_count_products": p6_duplicate_count_products,
    "c6_dedupe_orders": c6_dedupe_orders,
    "e3_roc_corners": e3_roc_corners,
    "m1_matrix_slots": m1_matrix_slots,
    "r5_stream_base": r5_stream_base,
    "a10_sketch_quantiles": a10_sketch_quantiles,
    "r4_stratified_sample": r4_stratified_sample,
    "r6_rank_factors": r6_rank_factors,
    "r2_cap_by_category": r2_cap_by_category,
}

ROWS_ONLY: dict[str, Query] = {
    "m1_matrix": m1_matrix,
    "m3_lr_scores": m3_lr_scores,
    "m4_rf_scores": m4_rf_scores,
    "m5_gbt_scores": m5_gbt_scores,
    "m5_gbt_metrics": m5_gbt_metrics,
    "m_compare_models": m_compare_models,
    "m7_cv_gbt": m7_cv_gbt,
    "m9_lr_coefficients": m9_lr_coefficients,
    "m10_feature_importance": m10_feature_importance,
    "m12_prediction_counts": m12_prediction_counts,
    "m12_holdout_predictions": m12_holdout_predictions,
    "s3_write_predictions": s3_write_predictions,
    "r1_interactions": r1_interactions,
    "r3_stacking": r3_stacking,
    "r5_stream_scores": r5_stream_scores,
    "m3_gradient": m3_gradient,
    "m7_fold_metrics": m7_fold_metrics,
}


def all_queries() -> dict[str, Query]:
    return {**SQL_CHECKED, **ROWS_ONLY}
