"""orderlens: order-satisfaction features, models and metrics as Spark jobs."""

from orderlens.fitting import FittedScorer, fit_base, fit_matrix_split, fit_scorer, score_tables
from orderlens.flow import run_flow
from orderlens.ml.evaluation import evaluation_report
from orderlens.plans.base import build_base
from orderlens.plans.state import FeatureState, fit_feature_state
from orderlens.sources.sinks import write_predictions
from orderlens.sources.tables import load_sources, read_table

__all__ = [
    "FeatureState", "FittedScorer", "build_base", "evaluation_report", "fit_base", "fit_feature_state",
    "fit_matrix_split", "fit_scorer", "load_sources", "read_table", "run_flow", "score_tables",
    "write_predictions",
]
