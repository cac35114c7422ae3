"""Drift, label and scoring jobs over the fact tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.columns import number_or_null
from modelwatch.operators.alerts import QUIET_DAYS, daily_share, detections, noise_floor
from modelwatch.operators.checks import require_single_version
from modelwatch.operators.contract import Contract
from modelwatch.operators.drift import WINDOWS, DriftReference, drift_metrics, fit_reference
from modelwatch.operators.joins import attach_truth
from modelwatch.operators.reconcile import mature_labels
from modelwatch.operators.scoring import predict_scores, score_requests
from modelwatch.schemas import FeatureSet
from modelwatch.sinks.tables import (
    append_labels,
    append_predictions,
    replace_table,
)
from modelwatch.sources.files import read_latest, read_traffic


def reference_from_split(
    dataset: DataFrame,
    model: PipelineModel,
    features: FeatureSet,
    numeric: Sequence[str],
    categorical: Mapping[str, Sequence],
    split: str = "val",
) -> DriftReference:
    """Fit the drift reference on one split, with the model's score as a monitored series.

    Unlike the model's own cleaning, text that is not a number stays missing here: the
    missing rate is itself watched.
    """
    rows = predict_scores(model, dataset.filter(F.col("split") == split).select(*features.all))
    for c in features.nullable_numeric:
        rows = rows.withColumn(c, number_or_null(c))
    return fit_reference(rows, numeric, categorical)


def drift_job(
    predictions: DataFrame,
    reference: DriftReference,
    champion: str,
    path: str,
    windows: Sequence[int] = WINDOWS,
) -> DataFrame:
    """Recompute all drift metrics and replace the table; refuses mixed or foreign versions."""
    require_single_version(predictions, champion)
    watched = [f for f in reference.features if f != "score"]
    traffic = read_traffic(predictions, watched)
    replace_table(drift_metrics(traffic, reference, windows), path)
    return read_latest(predictions.sparkSession, path)


def alert_report(
    metrics: DataFrame, predictions: DataFrame, shifted: Column, quiet_days: int = QUIET_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(noise floor, detections with the shifted share of the alert day)."""
    mix = daily_share(predictions, "event_time", shifted)
    return noise_floor(metrics, quiet_days), detections(metrics, quiet_days, mix)


def label_job(predictions: DataFrame, outcomes: DataFrame, path: str, window_days: int = 90) -> DataFrame:
    """Turn observed outcomes into label facts and append them."""
    labels = mature_labels(predictions, outcomes, window_days)
    append_labels(labels, predictions, path)
    return predictions.sparkSession.read.parquet(path)


def truth_job(predictions: DataFrame, dataset: DataFrame) -> DataFrame:
    """Ground truth of replayed predictions from the dataset they were drawn from."""
    return attach_truth(predictions, dataset, "customerID", "customer_id", "label")


def score_job(
    requests: DataFrame,
    model: PipelineModel,
    threshold: float,
    version: str,
    contract: Contract,
    predictions_path: str,
    quarantine_path: str,
    now: Column | None = None,
    **answers: str,
) -> None:
    """Score a batch of request records; the facts are stored before anything is answered."""
    facts, quarantine = score_requests(requests, model, threshold, version, contract, now=now, **answers)
    append_predictions(facts, predictions_path)
    quarantine.write.mode("append").parquet(quarantine_path)
