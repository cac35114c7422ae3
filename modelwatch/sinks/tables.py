"""Where results go. Facts are appended, derived tables replaced as a whole."""

from __future__ import annotations

import logging
import time

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators.checks import CheckFailed, outside_domain, require_empty
from modelwatch.operators.joins import key_match
from modelwatch.sinks.ledger import BUCKETS, KeyLedger, record_digest, unseen
from modelwatch.sources.files import POINTERS, current_versions, file_system

log = logging.getLogger(__name__)


def append_predictions(
    facts: DataFrame, path: str, time_column: str = "event_time", key: str = "request_id", buckets: int = BUCKETS
) -> int:
    """Append facts in one folder per event date, sorted by id inside each file; returns how many were new.

    An id is stored once, whatever day it comes back on: the table's `KeyLedger` holds all stored ids.
    Rows that repeat an id and what was asked are one request, and appending a batch again, whole or in
    part, adds nothing. Two different requests with one id raise before anything is written, and so do
    facts without an id.

    A failed write raises: an answer that was not recorded is not given. The batch is staged beside the
    ledger once, so it is scored once. The rebalance gathers a date into few files but splits a
    date too large for one task. One append at a time.
    """
    spark = facts.sparkSession
    ledger = KeyLedger(spark, path, key, facts.schema[key].dataType.simpleString(), buckets)
    try:
        ledger.recover(facts.withColumn("event_date", F.current_date()).schema)
        dated = facts.withColumn("event_date", F.to_date(time_column))
        batch = ledger.stage(dated).withColumn("record", record_digest(facts.columns, key))
        fresh = unseen(batch, ledger)
        n = fresh.count()
        if n or is_missing(spark, path):
            mark = ledger.open_mark(batch)
            rows = fresh.drop("record").hint("rebalance", F.col("event_date")).sortWithinPartitions("event_date", key)
            rows.write.mode("append").partitionBy("event_date").parquet(path)
            ledger.add(fresh)
            ledger.close_mark(mark)
        return n
    finally:
        ledger.close()


def append_request_log(rows: DataFrame, path: str) -> bool:
    """Append telemetry, best effort: a failure is logged and reported, not raised."""
    try:
        rows.withColumn("log_date", F.to_date("created_at")).write.mode("append").partitionBy("log_date").parquet(path)
        return True
    except Exception:
        log.exception("could not append the request log to %s", path)
        return False


def replace_table(df: DataFrame, path: str, version_column: str = "refresh", keep: int = 2) -> int:
    """Write a complete new refresh in a folder of its own, then its pointer; readers take the newest pointer.

    A reader sees the old refresh or the new one as a whole, whatever number of files either has, and a
    refresh that dies halfway is never seen. The newest `keep` refreshes stay for readers that are
    still at work; older ones and their pointers go.
    """
    spark = df.sparkSession
    version = time.time_ns()
    df.write.parquet(f"{path}/{version_column}={version}")
    fs, pointers = file_system(spark, f"{path}/{POINTERS}")
    fs.mkdirs(pointers)
    fs.create(file_system(spark, f"{path}/{POINTERS}/{version}")[1]).close()
    for old in sorted(current_versions(spark, path), reverse=True)[keep:]:
        for gone in (f"{path}/{POINTERS}/{old}", f"{path}/{version_column}={old}"):
            fs.delete(file_system(spark, gone)[1], True)
    return version


def is_missing(spark: SparkSession, path: str) -> bool:
    """No table at the path yet. A path that cannot be read as a table is an error."""
    try:
        spark.read.parquet(path)
        return False
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return True
        raise


def is_empty(spark: SparkSession, path: str) -> bool:
    """No table at the path, or one without rows. A path that cannot be read as a table is an error."""
    try:
        return spark.read.parquet(path).isEmpty()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return True
        raise


def write_guarded(df: DataFrame, path: str, reset: bool = False, partition_by: str | None = None) -> None:
    """Fill an empty table; a filled one is replaced only on request."""
    if not reset and not is_empty(df.sparkSession, path):
        raise CheckFailed(f"{path} is not empty; pass reset=True to replace it")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append_labels(labels: DataFrame, predictions: DataFrame, path: str) -> None:
    """Append label facts: 0 or 1, and together with the stored ones exactly one per prediction.

    Everything is checked before the write; a batch that breaks a rule leaves the table as it is.
    """
    new = labels.select("request_id", "label", "available_at")
    require_empty(outside_domain(new, "label", (0, 1)), "labels other than 0 and 1")
    spark = labels.sparkSession
    known = new if is_empty(spark, path) else spark.read.parquet(path).unionByName(new)
    match = key_match(predictions, known, "request_id").first()
    if match["max_left"] > 1 or match["max_right"] > 1:
        raise CheckFailed(f"a request has more than one prediction or label: {match.asDict()}")
    if match["left_only"] or match["right_only"]:
        raise CheckFailed(f"predictions without label, or labels without prediction: {match.asDict()}")
    new.write.mode("append").parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").option("header", True).csv(path)


def write_verification_sample(sample: DataFrame, path: str) -> None:
    sample.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_training_run(spark: SparkSession, run: dict, path: str) -> None:
    """One row of parameters and metrics per training run."""
    schema = (
        "run_name string, estimator string, scale_numeric boolean, min_precision double, seed int, "
        "pr_auc double, prevalence double, n_sample bigint, precision double, recall double, threshold double"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    spark.createDataFrame([tuple(run.get(n) for n in names)], schema).write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str, version: str, threshold: float) -> None:
    """Model and metadata side by side; the metadata is written last."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(str(version), float(threshold))], "version string, threshold double").coalesce(
        1
    ).write.mode("overwrite").json(f"{path}/meta")


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save as a table bucketed and sorted by the join key.

    Predictions and labels bucketed alike are joined without a shuffle on every later
    reconciliation.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
