"""Run the whole analysis on folders of CSV files.

    python -m orderlens --train DIR [--holdout DIR] --out DIR [--tune] [--save-model DIR] [--infer-types]
    python -m orderlens --score DIR --model DIR --out DIR [--infer-types]

``DIR`` holds ``products.csv``, ``orders.csv``, ``order_items.csv``,
``order_payments.csv`` and (training only) ``order_reviews.csv`` (a file or a
folder of part files each). Results are written as Parquet under ``--out``:
metrics, importance, coefficients, confusion, roc, gains and predictions.
``--save-model`` keeps the fitted state, formula and model; ``--score`` applies
a saved model to new tables without refitting anything. ``--infer-types`` reads the
files with the types that their cells fit instead of the declared ones.
"""

from __future__ import annotations

import argparse
import json
import os
import re

from pyspark.sql import SparkSession

from orderlens.fitting import FittedScorer, score_tables
from orderlens.flow import run_flow
from orderlens.ml.models import predictions
from orderlens.schemas import TABLES
from orderlens.session import dropping_staged
from orderlens.sources.sinks import write_predictions
from orderlens.sources.tables import load_sources


def _paths(folder: str, labelled: bool) -> dict[str, str]:
    names = [n for n in TABLES if labelled or n != "order_reviews"]
    out = {}
    for n in names:
        path = f"{folder.rstrip('/')}/{n}.csv"
        if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) and not os.path.exists(path):
            raise FileNotFoundError(path)          # paths with a scheme are left to the reader
        out[n] = path
    return out


def main(argv=None, spark: SparkSession | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="orderlens")
    ap.add_argument("--train")
    ap.add_argument("--holdout")
    ap.add_argument("--out", required=True)
    ap.add_argument("--tune", action="store_true", help="cross-validate the boosted-tree grid first")
    ap.add_argument("--save-model", help="folder for the fitted state, formula and model")
    ap.add_argument("--score", help="tables to score with --model (no fitting)")
    ap.add_argument("--model", help="folder written by --save-model")
    ap.add_argument("--infer-types", action="store_true", help="no declared schema: types that all cells fit")
    args = ap.parse_args(argv)
    if args.score and not args.model:
        ap.error("--score needs --model")
    if not args.score and not args.train:
        ap.error("--train or --score is required")
    spark = spark or SparkSession.builder.appName("orderlens").getOrCreate()
    with dropping_staged(spark):
        return _run(spark, args)


def _run(spark: SparkSession, args: argparse.Namespace) -> dict:
    if args.score:
        scorer = FittedScorer.load(spark, args.model)
        scored = score_tables(scorer, load_sources(spark, _paths(args.score, False), infer=args.infer_types))
        write_predictions(predictions(scored), os.path.join(args.out, "predictions"))
        summary = {"scored": args.score, "model": args.model, "kind": scorer.kind}
        print(json.dumps(summary))
        return summary
    train = load_sources(spark, _paths(args.train, True), infer=args.infer_types)
    holdout = load_sources(spark, _paths(args.holdout, False), infer=args.infer_types) if args.holdout else None
    res = run_flow(train, holdout, tune_gbt=args.tune,
                   predictions_path=os.path.join(args.out, "predictions") if holdout else None)
    outputs = {"metrics": res.metrics, "importance": res.importance, "coefficients": res.coefficients,
               "confusion": res.report["confusion"], "roc": res.report["roc"], "gains": res.report["gains"]}
    for name, df in outputs.items():
        if df is not None:
            df.write.mode("overwrite").parquet(os.path.join(args.out, name))
    if args.save_model:
        res.scorer.save(args.save_model)
    summary = {"shipping_threshold": res.state.shipping_threshold, "best_params": res.best_params,
               "metrics": {f"{r['model']}.{r['metric']}": r["value"] for r in res.metrics.collect()}}
    print(json.dumps(summary))
    return summary


if __name__ == "__main__":
    main()
