"""Features, scoring, monitoring and snapshot of a batch, as one chain of frames."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from tallyward.operators.features import area_features
from tallyward.operators.monitoring import drift, evaluate
from tallyward.operators.registry import PRODUCTION, has_production, resolve_model
from tallyward.operators.scoring import finish_predictions, scoring_frame
from tallyward.operators.serving import build_snapshot
from tallyward.operators.training import load_model
from tallyward.sources.tables import replace_slices

# The weekly evaluation window, in days before the run.
EVAL_FIRST, EVAL_LAST = 7, 1


def write_features(silver: DataFrame, path: str, start: date, end: date | None = None, by_slice: bool = True) -> None:
    """Daily run or backfill: one job whatever the number of dates.

    Stored silver is sliced by incident day, so only the slices of the window are read.
    """
    replace_slices(area_features(silver, start, end, by_slice=by_slice), path, ["process_date"])


def score_batch(features: DataFrame, model: PipelineModel, process_date: date, model_name: str | None,
                model_version: str | None, run_id: str | None = None) -> DataFrame:
    """H5: predictions of one process date; empty when it has no feature rows."""
    scored = model.transform(scoring_frame(features, process_date))
    return finish_predictions(scored, run_id or str(uuid.uuid4()), model_name, model_version)


def daily_scoring(features: DataFrame, registry: DataFrame, model_name: str, process_date: date,
                  predictions_path: str) -> bool:
    """Score with the Production model; False when there is none."""
    if not has_production(registry, model_name):
        return False
    chosen = resolve_model(registry, model_name, PRODUCTION).first()
    model = load_model(features.sparkSession, chosen["model_path"])
    predictions = score_batch(features, model, process_date, model_name, str(chosen["version"]))
    replace_slices(predictions, predictions_path, ["process_date"])
    return True


def weekly_monitoring(predictions: DataFrame | None, features: DataFrame, run_date: date,
                      evaluation_path: str, drift_path: str) -> None:
    """Evaluation of the past week and drift of the day before the run."""
    rows = evaluate(predictions, features, run_date - timedelta(days=EVAL_FIRST),
                    run_date - timedelta(days=EVAL_LAST), run_date)
    if rows is not None:
        replace_slices(rows, evaluation_path, ["process_date"])
    replace_slices(drift(features, predictions, run_date - timedelta(days=1), run_date), drift_path,
                   ["process_date"])


def publish_snapshot(predictions: DataFrame, ml_features: DataFrame, features: DataFrame, process_date: date,
                     path: str, names: DataFrame | None = None) -> None:
    """K1 with a file sink; ``replace_batch_jdbc`` is the database sink."""
    replace_slices(build_snapshot(predictions, ml_features, features, process_date, names), path, ["process_date"])
