"""Scoring orders as they arrive (README "real-time prediction").

New base rows land as Parquet files in a folder; a stateless Structured
Streaming query applies the fitted formula and model to each micro-batch and
appends ``(order_id, prediction, score)`` to a Parquet sink. The checkpoint
makes the sink exactly-once across restarts and lost executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.ml.evaluation import positive_probability
from orderlens.ml.matrix import apply_matrix
from orderlens.plans.base import KEY
from orderlens.session import work_root


def score_stream(spark: SparkSession, fitted, source_dir: str, schema: T.StructType,
                 out_dir: str, checkpoint_dir: str, available_now: bool = True):
    """Start the scoring stream; returns the ``StreamingQuery``."""
    rows = spark.readStream.schema(schema).parquet(source_dir)
    scored = fitted.model.transform(apply_matrix(fitted.matrix, rows))
    out = scored.select(KEY, "prediction", positive_probability().alias("score"))
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(out_dir)


def score_batch_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the labelled tables, land the holdout base rows as files, run
    the stream to completion and return the scored rows."""
    from orderlens.fitting import fit_scorer
    from orderlens.plans.base import build_base
    from orderlens.sources.driver_views import order_tables

    root = f"{work_root(spark).rstrip('/')}/orderlens/stream-{uuid.uuid4().hex}"
    tables = order_tables(spark, sf_dir)
    fitted = fit_scorer(tables, kind="gbt")
    holdout = build_base({k: v for k, v in tables.items() if k != "order_reviews"}, fitted.state)
    holdout.write.mode("overwrite").parquet(f"{root}/in")
    q = score_stream(spark, fitted, f"{root}/in", holdout.schema, f"{root}/out", f"{root}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(KEY, "prediction", F.col("score"))
