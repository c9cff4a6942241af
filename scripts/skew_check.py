"""Task-level evidence for hot keys, from Spark's event log.

Derives skewed tables from the driver's tables (a third of the line items,
payments and reviews remapped to one order, a third of the items to one
product, a third of the order rows copies of one order), runs the headline feature jobs, and reads the event log written to a
scratch folder: per stage, the task count and the largest task's share of the
stage's input/shuffle records. Writes SKEW.md.

    python scripts/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from orderlens.fitting import fit_base  # noqa: E402
from orderlens.plans.items import item_aggregates  # noqa: E402
from orderlens.plans.payments import payment_features  # noqa: E402
from orderlens.plans.products import product_features  # noqa: E402
from orderlens.plans.reviews import review_features  # noqa: E402
from orderlens.session import ensure_checkpoint_dir  # noqa: E402
from orderlens.sources import driver_views as dv  # noqa: E402

HOT_ORDER, HOT_PART = 7, 1


def derive(spark, sf, out):
    # many files, as large inputs have: AQE splits a skewed partition by groups
    # of map outputs, which needs more than one map task
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    third = (F.col("l_orderkey") + F.col("l_linenumber")) % 3
    li.withColumn("l_orderkey", F.when(third == 0, F.lit(HOT_ORDER).cast("long")).otherwise(F.col("l_orderkey"))) \
      .withColumn("l_partkey", F.when(third == 1, F.lit(HOT_PART).cast("long")).otherwise(F.col("l_partkey"))) \
      .repartition(16).write.parquet(f"{out}/lineitem.parquet")
    spark.read.parquet(f"{sf}/events.parquet") \
        .withColumn("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(2 * HOT_ORDER).cast("long"))
                    .otherwise(F.col("event_id"))).repartition(16).write.parquet(f"{out}/events.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    copy = orders.filter(F.col("o_orderkey") == HOT_ORDER).first()
    hot = F.col("o_orderkey") % 3 == 0          # a third of the order rows: copies of one order
    orders.select([F.when(hot, F.lit(copy[c])).otherwise(F.col(c)).cast(orders.schema[c].dataType).alias(c)
                   for c in orders.columns]).repartition(16).write.parquet(f"{out}/orders.parquet")
    spark.read.parquet(f"{sf}/part.parquet").write.parquet(f"{out}/part.parquet")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="skew-", dir="/tmp")
    logs = os.path.join(scratch, "events")
    os.makedirs(logs)
    spark = (SparkSession.builder.master("local[8]").appName("skew-check")
             .config("spark.sql.shuffle.partitions", "16")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", f"file://{logs}")
             .config("spark.eventLog.compress", "false")
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")
             # small test data: lower the skew thresholds so AQE acts as it would on large partitions
             .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "256k")
             .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, os.path.join(scratch, "ckpt"))
    skewed = os.path.join(scratch, "data")
    derive(spark, sf, skewed)
    t = dv.order_tables(spark, skewed)

    def run(desc, fn):
        spark.sparkContext.setJobDescription(desc)
        fn()

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    run("item aggregates, product join sort-merged",
        lambda: noop(item_aggregates(t["order_items"], product_features(t["products"]))))
    run("payment features", lambda: noop(payment_features(t["order_payments"])))
    run("review features", lambda: noop(review_features(t["order_reviews"])))
    run("state + base table", lambda: fit_base(t))
    spark.stop()

    jobs, stage_job, tasks = {}, {}, defaultdict(list)
    for path in glob.glob(os.path.join(logs, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description")
                    for sid in ev.get("Stage IDs", []):
                        stage_job[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    rec = (m.get("Input Metrics", {}).get("Records Read", 0)
                           + m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0))
                    tasks[ev["Stage ID"]].append(rec)
    rows = []
    for sid in sorted(tasks):
        desc = stage_job.get(sid)
        recs = tasks[sid]
        total = sum(recs)
        if not desc or total == 0:
            continue
        rows.append((desc, sid, len(recs), total, max(recs), max(recs) / total))
    out = ["# Hot keys: largest task per stage", "",
           "Generated by `scripts/skew_check.py` from Spark's event log. Input: the driver's sf0.1 tables with",
           "a third of line items, payments and reviews remapped to one order, a third of items to one",
           "product and a third of the order rows turned into copies of one order, written as 16 files each. Broadcast joins off; AQE on, with skew and advisory sizes",
           "lowered to 256 KB so that it acts on this small data as it would on large partitions.",
           "`records` = input plus shuffle records read by the stage's tasks.", "",
           "Reading: no multi-task stage gives its largest task more than about one task's fair share,",
           "although a third of the rows carry one order key and a third one product key. Aggregations",
           "collapse the hot order map-side (partial aggregates, partial WindowGroupLimit); the sort-merge",
           "join of items to products has its hot product partition split by AQE (the 15-task stage).",
           "Single-task stages read one small file (products, orders) or were coalesced by AQE because",
           "their whole stage is below the advisory size.", "",
           "| job | stage | tasks | records | largest task | share |", "|---|---|---|---|---|---|"]
    out += [f"| {d} | {s} | {n} | {tot:,} | {mx:,} | {sh:.1%} |" for d, s, n, tot, mx, sh in rows]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "SKEW.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
