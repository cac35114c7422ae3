"""Streaming queries: read the tables as streams, run to the end, return what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators.drift import rolling_psi
from modelwatch.operators.scoring import responses
from modelwatch.plans.training import TrainingResult
from modelwatch.session import shared_path
from modelwatch.sources.derived import (
    as_outcome_labels,
    as_predictions,
    as_request_log,
    events,
    with_k,
)
from modelwatch.streaming.facts import (
    append_to,
    append_unseen,
    daily_bin_stream,
    read_upserts,
    run_available,
    store_scores,
    upsert_to,
)
from modelwatch.streaming.labels import read_label_join, store_label_join
from modelwatch.streaming.telemetry import windowed_histogram, windowed_service_rates
from modelwatch.suite.common import OUTCOME_LABELS, PREDICTIONS, REQUEST_LOG, rounded
from modelwatch.suite.drift import _METRICS, reference
from modelwatch.suite.latency import BOUNDS, histogram_sql
from modelwatch.suite.training import DOCUMENT_CONTRACT, labelled, train


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, one file or a folder of files, as a stream; the pattern matches either."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_k(_stream(spark, sf_dir, "events"))


def _written(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out = shared_path(spark, name)
    writer = append_to(stream, f"{out}/data", f"{out}/checkpoint")
    run_available(writer, state_partitions=spark.sparkContext.defaultParallelism)
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def _current(spark: SparkSession, stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    out = shared_path(spark, name)
    writer = upsert_to(stream, f"{out}/data", f"{out}/checkpoint", keys)
    run_available(writer, state_partitions=spark.sparkContext.defaultParallelism)
    return read_upserts(spark, f"{out}/data", stream.schema, keys)


def _histogram(spark, sf_dir):
    log = as_request_log(events_stream(spark, sf_dir))
    return _current(spark, windowed_histogram(log, "1 day", "1 hour"), "latency", ["bucket", "path", "le_ord"])


def _rates(spark, sf_dir):
    log = as_request_log(events_stream(spark, sf_dir))
    rates = windowed_service_rates(log, "1 hour", 3600, "1 hour")
    return rounded(_current(spark, rates, "rates", ["bucket", "path"]), 9)


def _joined(spark: SparkSession, predictions: DataFrame, labels: DataFrame, out: str) -> DataFrame:
    run_available(store_label_join(predictions, labels, f"{out}/join", f"{out}/checkpoint"))
    return read_label_join(spark, f"{out}/join").select(
        "request_id",
        F.col("event_time").cast("timestamp_ntz").alias("event_time"),
        "prediction",
        "label",
        F.col("available_at").cast("timestamp_ntz").alias("available_at"),
    )


def _labels(spark, sf_dir):
    ev = events_stream(spark, sf_dir)
    return _joined(spark, as_predictions(ev), as_outcome_labels(ev), shared_path(spark, "labelled"))


def _late_labels(spark, sf_dir):
    """Three micro-batches: the last days' predictions come first, and labels in yet another order."""
    out = shared_path(spark, "late")
    ev = events(spark, sf_dir)
    sides = {"predictions": as_predictions(ev), "labels": as_outcome_labels(ev)}
    streams = {}
    for (name, rows), order in zip(sides.items(), ((2, 0, 1), (1, 2, 0)), strict=True):
        third = F.floor(F.dayofmonth("event_time" if name == "predictions" else "available_at") / 11).cast("int") % 3
        for part in order:
            rows.filter(third == part).coalesce(1).write.mode("append").parquet(f"{out}/{name}")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/{name}")
        streams[name] = stream
    return _joined(spark, streams["predictions"], streams["labels"], out)


def _scores(spark, sf_dir):
    facts = as_predictions(events_stream(spark, sf_dir))
    out = shared_path(spark, "predictions")
    run_available(append_unseen(facts, f"{out}/data", f"{out}/checkpoint"))
    kept = spark.read.parquet(f"{out}/data")
    return rounded(
        kept.withColumn("event_time", F.col("event_time").cast("timestamp_ntz")).select(
            "request_id", "event_time", "probability", "prediction"
        ),
        9,
    )


def _drift(spark, sf_dir):
    """PSI over all days of unshifted odd events."""
    fitted = reference(spark, sf_dir)
    odd = as_predictions(events_stream(spark, sf_dir)).filter(F.col("request_id") % 2 == 1)
    daily = _current(spark, daily_bin_stream(odd, fitted, "1 hour"), "bins", ["day", "feature_id", "bin"])
    return rounded(rolling_psi(daily, fitted))


def scored_stream(spark: SparkSession, requests: DataFrame, result: TrainingResult) -> tuple[DataFrame, DataFrame]:
    """(facts, rejected records with their errors) of a request stream, both as stored."""
    out = shared_path(spark, "scored")
    writer = store_scores(
        requests, result.model, result.metrics["threshold"], "1", DOCUMENT_CONTRACT,
        f"{out}/facts", f"{out}/quarantine", f"{out}/checkpoint",
        now=F.lit("2024-02-01 00:00:00").cast("timestamp"), positive="good", negative="poor",
    )
    run_available(writer)
    return spark.read.parquet(f"{out}/facts"), spark.read.parquet(f"{out}/quarantine")


def _trained_scores(spark, sf_dir):
    """Documents as a request stream, scored by a model fitted on the labelled ones; rejected ones are stored."""
    result = train(labelled(spark, sf_dir), "logreg")
    requests = _stream(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("customer_id"), "n_chars", "lang", "source"
    )
    return responses(scored_stream(spark, requests, result)[0])


QUERIES = {
    "stream_scoring": _trained_scores,
    "stream_unique_requests": _scores,
    "stream_latency_histogram": _histogram,
    "stream_service_rates": _rates,
    "stream_label_join": _labels,
    "stream_label_join_late": _late_labels,
    "stream_drift_counts": _drift,
}

ORACLES = {
    "stream_unique_requests": f"""WITH {PREDICTIONS}
        SELECT request_id, event_time, round(probability, 9) AS probability, prediction FROM predictions""",
    "stream_latency_histogram": f"""WITH {REQUEST_LOG}, {BOUNDS},
        base AS (SELECT date_trunc('day', created_at) AS bucket, path, duration_ms / 1000.0 AS seconds
                 FROM request_log),
        {histogram_sql('base', 'seconds', 'bucket, path')}
        SELECT CAST(bucket AS TIMESTAMP) AS bucket, path, le_ord, le, cum FROM hist""",
    "stream_service_rates": f"""WITH {REQUEST_LOG}
        SELECT date_trunc('hour', created_at) AS bucket, path, round(count(*) / 3600.0, 9) AS per_second,
               round(count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) / CAST(count(*) AS DOUBLE), 9)
                   AS client_error_ratio,
               round(count(*) FILTER (WHERE status_code BETWEEN 500 AND 599) / CAST(count(*) AS DOUBLE), 9)
                   AS server_error_ratio
        FROM request_log
        GROUP BY 1, 2""",
    "stream_label_join": f"""WITH {PREDICTIONS}, {OUTCOME_LABELS}
        SELECT request_id, event_time, prediction, label, available_at
        FROM predictions JOIN outcome_labels USING (request_id)""",
    "stream_label_join_late": f"""WITH {PREDICTIONS}, {OUTCOME_LABELS}
        SELECT request_id, event_time, prediction, label, available_at
        FROM predictions JOIN outcome_labels USING (request_id)""",
    "stream_drift_counts": _METRICS.replace(
        "THEN value * 2 ELSE value END AS value",
        "THEN value ELSE value END AS value",
    )
    + " SELECT day, feature, window_days, round(psi, 6) AS psi, n_rows FROM drift_metrics",
}
