"""Headline timings at ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]``.

Prints one JSON line: {"metric", "value" (sum of query seconds), "unit",
"queries": {name: seconds}, "sf", ...}. Each step is forced with a ``noop``
write (full execution, nothing collected) or its own action. Steps mirror the
reference's work: feature tables, base table, formula matrix + cache,
the three model fits, the evaluation curves, and scoring + writing the
holdout predictions with the training state.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orderlens.ml import evaluation as ev  # noqa: E402
from orderlens.ml.models import fit_model  # noqa: E402
from orderlens.ml.models import predictions  # noqa: E402
from orderlens.fitting import FittedScorer, fit_base, fit_matrix_split, score_tables  # noqa: E402
from orderlens.plans.items import item_aggregates  # noqa: E402
from orderlens.plans.payments import payment_features  # noqa: E402
from orderlens.plans.products import product_features  # noqa: E402
from orderlens.plans.reviews import review_features  # noqa: E402
from orderlens.session import build_session  # noqa: E402
from orderlens.sources import driver_views as dv  # noqa: E402
from orderlens.sources.sinks import write_predictions  # noqa: E402


def _run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    scratch = tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), checkpoint_dir=scratch)
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    tables = dv.order_tables(spark, sf_dir)
    spark.read.parquet(f"{sf_dir}/part.parquet").limit(1).collect()   # session warm-up

    timed("item_features", lambda: _run(item_aggregates(tables["order_items"],
                                                        product_features(tables["products"]))))
    timed("payment_features", lambda: _run(payment_features(tables["order_payments"])))
    timed("review_features", lambda: _run(review_features(tables["order_reviews"])))
    state, base = timed("state_and_base", lambda: fit_base(tables))
    matrix, tr, va = timed("matrix_and_cache", lambda: fit_matrix_split(base))
    gbt = timed("gbt_fit", lambda: fit_model("gbt", tr))
    timed("lr_fit", lambda: fit_model("lr", tr))
    timed("rf_fit", lambda: fit_model("rf", tr))

    def evaluate():
        scored = gbt.transform(va).select("label", ev.positive_probability().alias("score"), "prediction")
        rep = ev.evaluation_report(scored)
        out = {"accuracy": rep["accuracy"].first()["accuracy"], "auc": rep["auc"].first()["auc"]}
        _run(rep["roc"])
        _run(rep["gains"])
        _run(rep["confusion"])
        return out

    quality = timed("gbt_evaluate", evaluate)

    def holdout():
        fitted = FittedScorer(state, matrix, gbt, "gbt")
        scored = score_tables(fitted, {k: v for k, v in tables.items() if k != "order_reviews"})
        write_predictions(predictions(scored), f"{scratch}/predictions")

    timed("holdout_score_write", holdout)
    def events_report():
        rep = ev.evaluation_report(dv.scored_events(spark, sf_dir))
        rep["auc"].first()
        _run(rep["roc"])
        _run(rep["gains"])

    timed("curves_events", events_report)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": cpus, "validation": {k: round(v, 4) for k, v in quality.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
