"""Training, verification, promotion and the regression gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators.checks import CheckFailed
from modelwatch.operators.evaluation import (
    GATE_MIN_PR_AUC,
    MIN_PRECISION,
    bootstrap_band,
    evaluate,
    gate,
    precision_recall_at,
    rank_scores,
    summary_of,
    threshold_of,
)
from modelwatch.operators.features import LABEL, fit
from modelwatch.operators.joins import require_parity
from modelwatch.operators.profile import sample_first
from modelwatch.operators.scoring import predict_scores
from modelwatch.schemas import FeatureSet
from modelwatch.sinks.tables import append_training_run, save_model, write_verification_sample
from modelwatch.sources.files import load_champion, load_model, read_verification_sample

SAMPLE_ROWS = 50
SAMPLE_TOLERANCE = 1e-9


@dataclass(frozen=True)
class TrainingResult:
    params: dict
    metrics: dict
    model: PipelineModel
    sample: DataFrame


def run_training(
    dataset: DataFrame,
    features: FeatureSet,
    estimator: str = "logreg",
    scale_numeric: bool = True,
    min_precision: float = MIN_PRECISION,
    seed: int = 42,
    key: str = "customerID",
    max_iter: int | None = None,
) -> TrainingResult:
    """Fit on the train split, measure on val, pick the threshold, keep a sample to verify by.

    `dataset` has the key, the features, a 0/1 `label` and a `split` column.
    """
    train = dataset.filter("split = 'train'")
    model = fit(estimator, train, features, scale_numeric, seed, max_iter)
    val = predict_scores(model, dataset.filter("split = 'val'").select(key, *features.all, LABEL))
    # Scored once, read by the ranking and the sample.
    val = val.persist()
    try:
        ranked = rank_scores(val, "score", LABEL)
        summary = summary_of(ranked).first().asDict()
        precision, recall, threshold = threshold_of(ranked, min_precision)
        rows = sample_first(val, key, SAMPLE_ROWS).collect()
    finally:
        val.unpersist()
    sample = dataset.sparkSession.createDataFrame(rows, val.schema).select(
        key, *features.all, F.col("score").alias("expected_score")
    )
    params = {
        "estimator": estimator,
        "scale_numeric": scale_numeric,
        "min_precision": min_precision,
        "seed": seed,
    }
    metrics = {**summary, "precision": precision, "recall": recall, "threshold": threshold}
    return TrainingResult(params, metrics, model, sample)


def log_run(result: TrainingResult, run_name: str, folder: str, runs_path: str) -> None:
    """Keep the model, the verification sample and one row of parameters and metrics."""
    spark = result.sample.sparkSession
    save_model(result.model, folder, run_name, result.metrics["threshold"])
    write_verification_sample(result.sample, f"{folder}/verification_sample")
    append_training_run(spark, {"run_name": run_name, **result.params, **result.metrics}, runs_path)


def compare_runs(runs: DataFrame) -> DataFrame:
    """Runs by ranking quality, best first."""
    return runs.select("run_name", "estimator", "pr_auc", "recall", "threshold").orderBy(
        F.desc("pr_auc"), "run_name"
    )


def verify_model(model: PipelineModel, sample: DataFrame, key: str = "customerID",
                 tolerance: float = SAMPLE_TOLERANCE) -> None:
    """The saved model must reproduce, row by row, the scores logged at training time."""
    again = predict_scores(model, sample.drop("expected_score"), "score")
    require_parity(again, sample, key, {"score": "expected_score"}, tolerance)


def promote(spark: SparkSession, path: str, model_path: str, key: str = "customerID") -> None:
    """Point the champion record at a logged model, if that reproduces its verification sample."""
    model, version, threshold = load_model(spark, model_path)
    verify_model(model, read_verification_sample(spark, f"{model_path}/verification_sample"), key)
    spark.createDataFrame(
        [(model_path, str(version), float(threshold))], "model_path string, version string, threshold double"
    ).coalesce(1).write.mode("overwrite").json(path)


def run_gate(
    model: PipelineModel,
    dataset: DataFrame,
    features: FeatureSet,
    threshold: float,
    minimum: float = GATE_MIN_PR_AUC,
    key: str = "customerID",
    split: str = "eval_frozen",
) -> DataFrame:
    """One row: gate outcome on the frozen split, with precision and recall at the threshold."""
    frozen = dataset.filter(F.col("split") == split).select(key, *features.all, LABEL)
    scored = predict_scores(model, frozen)
    metrics = evaluate(scored, "score", LABEL)
    point = precision_recall_at(scored, threshold, "score", LABEL).select("precision", "recall")
    return gate(metrics, minimum).crossJoin(metrics.select("prevalence", "n_sample")).crossJoin(point)


def gate_champion(
    spark: SparkSession,
    path: str,
    dataset: DataFrame,
    features: FeatureSet,
    minimum: float = GATE_MIN_PR_AUC,
    key: str = "customerID",
) -> DataFrame:
    """Outcome of the gate for the champion of the record at `path`; a failed gate raises."""
    model, _, threshold = load_champion(spark, path)
    outcome = run_gate(model, dataset, features, threshold, minimum, key)
    row = outcome.first()
    if not row["passed"]:
        raise CheckFailed(f"{row['metric']} {row['value']:.4f} is below {minimum:.4f}")
    return outcome


def run_bootstrap(
    model: PipelineModel, dataset: DataFrame, features: FeatureSet, n_iterations: int = 1000,
    seed: int = 42, key: str = "customerID", split: str = "eval_frozen",
) -> DataFrame:
    frozen = dataset.filter(F.col("split") == split).select(key, *features.all, LABEL)
    return bootstrap_band(predict_scores(model, frozen), n_iterations, seed, "score", LABEL)
