"""Training and scoring over labelled documents (no SQL twin: iterative fits)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators.contract import Contract, FieldRule
from modelwatch.operators.scoring import responses
from modelwatch.operators.splits import stratified_split
from modelwatch.plans.monitoring import score_job
from modelwatch.plans.training import TrainingResult, run_gate, run_training
from modelwatch.schemas import FeatureSet
from modelwatch.session import materialise, shared_path
from modelwatch.sources.files import table

FEATURES = FeatureSet(numeric=["n_chars"], categorical={"lang": [], "source": []})
DOCUMENT_CONTRACT = Contract(
    fields=(
        FieldRule("customer_id", "int"),
        FieldRule("n_chars", "int", minimum=1),
        FieldRule("lang", "string"),
        FieldRule("source", "string"),
    )
)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their split, as the stored dataset the jobs read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    data = docs.join(truth, "doc_id")
    return materialise(data.join(stratified_split(data, "doc_id", "label"), "doc_id"))


def train(dataset: DataFrame, name: str, max_iter: int | None = None) -> TrainingResult:
    return run_training(
        dataset, FEATURES, name, scale_numeric=name != "gb", key="doc_id", max_iter=max_iter
    )


def _row(spark: SparkSession, result: TrainingResult) -> DataFrame:
    m = result.metrics
    schema = "estimator string, pr_auc double, prevalence double, n_sample bigint, precision double, recall double, threshold double"
    return spark.createDataFrame(
        [
            (
                result.params["estimator"], m["pr_auc"], m["prevalence"], m["n_sample"],
                m["precision"], m["recall"], m["threshold"],
            )
        ],
        schema,
    )


def _gate(spark, sf_dir):
    dataset = labelled(spark, sf_dir)
    result = train(dataset, "logreg")
    return run_gate(result.model, dataset, FEATURES, result.metrics["threshold"], key="doc_id")


def scored(spark: SparkSession, requests: DataFrame, result: TrainingResult) -> tuple[DataFrame, DataFrame]:
    """(facts, rejected records with their errors), both as stored."""
    out = shared_path(spark, "scores")
    score_job(
        requests, result.model, result.metrics["threshold"], "1", DOCUMENT_CONTRACT, f"{out}/facts", f"{out}/quarantine",
        now=F.lit("2024-02-01 00:00:00").cast("timestamp"), positive="good", negative="poor",
    )
    return spark.read.parquet(f"{out}/facts"), spark.read.parquet(f"{out}/quarantine")


def _score(spark, sf_dir):
    """Score every document, labelled or not; those that the contract rejects are stored with their errors."""
    result = train(labelled(spark, sf_dir), "logreg")
    requests = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("customer_id"), "n_chars", "lang", "source"
    )
    return responses(scored(spark, requests, result)[0])


QUERIES = {
    "train_logreg": lambda s, d: _row(s, train(labelled(s, d), "logreg")),
    "train_logreg_balanced": lambda s, d: _row(s, train(labelled(s, d), "logreg_balanced")),
    "train_gbt": lambda s, d: _row(s, train(labelled(s, d), "gb")),
    "gate_frozen": _gate,
    "score_requests": _score,
}

ORACLES: dict[str, str] = {}
