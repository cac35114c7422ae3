"""Sinks and file sources: write a table to the shared folder, read it back, report on it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.operators.checks import CheckFailed
from modelwatch.operators.parity import require_same_rows
from modelwatch.operators.profile import sample_first
from modelwatch.operators.scoring import identify
from modelwatch.operators.service import predictions_daily
from modelwatch.session import shared_path
from modelwatch.sinks import tables as sinks
from modelwatch.sources import files
from modelwatch.sources.derived import POSITIVE, outcome_labels, predictions, request_log
from modelwatch.suite.common import OUTCOME_LABELS, PREDICTIONS, REQUEST_LOG, rounded
from modelwatch.suite.service import ORACLES as SERVICE_ORACLES
from modelwatch.suite.splits import ORACLES as SPLIT_ORACLES
from modelwatch.suite.splits import manifest

CUSTOMER_CSV = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.LongType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)


def _stored_predictions(spark, sf_dir):
    """Appended facts, all read back from their date folders and compared."""
    path = shared_path(spark, "facts")
    facts = predictions(spark, sf_dir)
    sinks.append_predictions(facts, path)
    stored = spark.read.parquet(path)
    require_same_rows(stored.drop("event_date"), facts, "facts")
    return stored.select("request_id", "event_time", "prediction", "model_version")


def _ledgered_predictions(spark, sf_dir):
    """Three appends whose batches overlap; what was stored before comes back on another day and is not stored again."""
    path = shared_path(spark, "ledgered")
    facts = predictions(spark, sf_dir)
    later = facts.withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 40 DAYS"))
    part = F.col("request_id") % 4
    sinks.append_predictions(facts.filter(part < 2), path)
    sinks.append_predictions(facts.filter(part == 2).unionByName(later.filter(part == 0)), path)
    sinks.append_predictions(facts.filter(part == 3).unionByName(later.filter(part < 3)), path)
    stored = spark.read.parquet(path)
    return rounded(stored.select("request_id", "event_time", "probability", "prediction"), 9)


def _record_identity(spark, sf_dir):
    """Request records without an id, the same ones in two files, the first file read twice: each is one request."""
    raw = files.table(spark, sf_dir, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    path = shared_path(spark, "identity")
    for name in ("first", "second"):
        raw.write.json(f"{path}/{name}")
    for name in ("first", "second", "first"):
        records = spark.read.schema(raw.schema).json(f"{path}/{name}")
        facts = identify(files.with_position(records)).withColumn("event_time", F.col("day").cast("timestamp"))
        sinks.append_predictions(facts, f"{path}/facts")
    stored = spark.read.parquet(f"{path}/facts")
    return stored.groupBy("event_type", "day").agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("n_ids"))


def _stored_request_log(spark, sf_dir):
    path = shared_path(spark, "log")
    sinks.append_request_log(request_log(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.col("log_date").alias("day"), "path").agg(
        F.count("*").alias("n_requests")
    )


def _replaced_table(spark, sf_dir):
    """Two refreshes of a derived table: readers see the second one as a whole."""
    path = shared_path(spark, "daily")
    daily = predictions_daily(predictions(spark, sf_dir), POSITIVE)
    sinks.replace_table(daily.withColumn("positive_share", F.lit(-1.0)), path)
    sinks.replace_table(daily, path)
    return rounded(files.read_latest(spark, path))


def _refused_and_reset(spark, sf_dir):
    """A filled table refuses a second fill and is replaced on request; a refresh without its pointer is not seen."""
    path = shared_path(spark, "guarded")
    daily = predictions_daily(predictions(spark, sf_dir), POSITIVE)
    wrong = daily.withColumn("positive_share", F.lit(-1.0))
    sinks.write_guarded(wrong, f"{path}/table")
    try:
        sinks.write_guarded(daily, f"{path}/table")
    except CheckFailed:
        sinks.write_guarded(daily, f"{path}/table", reset=True)
    sinks.replace_table(spark.read.parquet(f"{path}/table"), f"{path}/refreshes")
    wrong.write.parquet(f"{path}/refreshes/refresh=9999999999999999999")  # died before its pointer
    return rounded(files.read_latest(spark, f"{path}/refreshes"))


def _stored_labels(spark, sf_dir):
    """Labels appended to an empty table, one per prediction."""
    path = shared_path(spark, "labels")
    labels = outcome_labels(spark, sf_dir)
    sinks.write_guarded(labels.limit(0), path)
    sinks.append_labels(labels, predictions(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("label").agg(
        F.count("*").alias("n"), F.max("available_at").alias("last_available")
    )


def _manifest_csv(spark, sf_dir):
    path = shared_path(spark, "manifest")
    sinks.write_manifest(manifest(spark, sf_dir).withColumnRenamed("c_custkey", "customerID"), path)
    return files.read_manifest(spark, path).select(F.col("customerID").cast("bigint").alias("c_custkey"), "split")


def _dataset_csv(spark, sf_dir):
    path = shared_path(spark, "dataset")
    customers = files.table(spark, sf_dir, "customer").select(*CUSTOMER_CSV.names)
    customers.write.option("header", True).csv(path)
    stored = files.read_csv(spark, path, CUSTOMER_CSV)
    require_same_rows(stored, customers, "customers")
    return rounded(stored)


def _sample_json(spark, sf_dir):
    path = shared_path(spark, "sample")
    scored = predictions(spark, sf_dir).select("request_id", "value", "k", "event_type", "probability")
    sample = sample_first(scored, "request_id", 50)
    sinks.write_verification_sample(sample, path)
    return rounded(spark.read.schema(sample.schema).json(path), 9)


def _service_log(spark, sf_dir):
    """One JSON line per request, read back with the log's schema."""
    path = shared_path(spark, "service-log")
    lines = request_log(spark, sf_dir).select(
        F.to_json(
            F.struct(
                F.col("request_id").cast("string").alias("request_id"),
                "path",
                "status_code",
                F.round("duration_ms", 2).alias("duration_ms"),
                F.when(F.col("status_code") == 200, "1").alias("model_version"),
            )
        ).alias("value")
    )
    lines.write.text(path)
    return rounded(
        files.read_service_log(spark, path)
        .groupBy("path", "status_code")
        .agg(
            F.count("*").alias("n"),
            F.count("model_version").alias("n_answered"),
            F.sum("duration_ms").alias("total_ms"),
        ),
        4,
    )


QUERIES = {
    "stored_predictions": _stored_predictions,
    "ledgered_predictions": _ledgered_predictions,
    "record_identity": _record_identity,
    "stored_request_log": _stored_request_log,
    "replaced_table": _replaced_table,
    "refused_and_reset": _refused_and_reset,
    "stored_labels": _stored_labels,
    "manifest_csv": _manifest_csv,
    "dataset_csv": _dataset_csv,
    "verification_sample_json": _sample_json,
    "service_log_json": _service_log,
}

ORACLES = {
    "stored_predictions": f"""WITH {PREDICTIONS}
        SELECT request_id, event_time, prediction, model_version FROM predictions""",
    "ledgered_predictions": f"""WITH {PREDICTIONS}
        SELECT request_id, event_time, round(probability, 9) AS probability, prediction FROM predictions""",
    "record_identity": """SELECT event_type, CAST(ts AS DATE) AS day, 2 * count(*) AS n, 2 * count(*) AS n_ids
        FROM events GROUP BY ALL""",
    "stored_request_log": f"""WITH {REQUEST_LOG}
        SELECT CAST(created_at AS DATE) AS day, path, count(*) AS n_requests FROM request_log GROUP BY ALL""",
    "replaced_table": SERVICE_ORACLES["predictions_daily"],
    "refused_and_reset": SERVICE_ORACLES["predictions_daily"],
    "stored_labels": f"""WITH {PREDICTIONS}, {OUTCOME_LABELS}
        SELECT label, count(*) AS n, max(available_at) AS last_available FROM outcome_labels GROUP BY label""",
    "manifest_csv": SPLIT_ORACLES["stratified_split"],
    "dataset_csv": """SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment
        FROM customer""",
    "verification_sample_json": f"""WITH {PREDICTIONS}
        SELECT request_id, round(value, 9) AS value, k, event_type, round(probability, 9) AS probability
        FROM predictions ORDER BY request_id LIMIT 50""",
    "service_log_json": f"""WITH {REQUEST_LOG}
        SELECT path, status_code, count(*) AS n, count(*) FILTER (WHERE status_code = 200) AS n_answered,
               round(sum(duration_ms), 4) AS total_ms
        FROM request_log GROUP BY ALL""",
}
