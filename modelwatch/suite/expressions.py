"""Scalar expressions, scans, reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.functions import columns as fx
from modelwatch.operators.joins import union_tagged
from modelwatch.operators.profile import sample_first
from modelwatch.sources.derived import EVENT_TYPES, events, outcome_labels, predictions, request_log
from modelwatch.sources.files import between, read_prediction_keys, read_traffic, table
from modelwatch.suite.common import EVENTS, OUTCOME_LABELS, PREDICTIONS, REQUEST_LOG, rounded


def _parse_numbers(spark, sf_dir):
    """Numbers arriving as text: plain, blank, padded, with a type suffix, or not a number."""
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.col("k").cast("string"))
        .when(kind == 1, F.lit("  "))
        .when(kind == 2, F.concat(F.lit(" "), F.col("k").cast("string"), F.lit(".50 ")))
        .when(kind == 3, F.concat(F.col("k").cast("string"), F.lit("d")))
        .otherwise(F.lit("n/a"))
    )
    return events(spark, sf_dir).select(
        "event_id",
        fx.number_or_null(text).alias("number"),
        fx.number_or_zero(text).alias("number_or_zero"),
        fx.blank_to_null(F.when(kind <= 2, text)).alias("blank_is_null"),
    )


def _calendar(spark, sf_dir):
    """Day, week, offsets and differences of prediction and label times."""
    joined = predictions(spark, sf_dir).join(outcome_labels(spark, sf_dir), "request_id")
    return joined.select(
        "request_id",
        fx.day_of("event_time").alias("day"),
        fx.week_of("event_time").alias("week"),
        fx.plus_days("event_time", F.col("k")).alias("plus_k_days"),
        fx.whole_days(fx.day_of("available_at"), fx.day_of("event_time")).alias("days_between"),
        F.round(fx.fractional_days("available_at", "event_time"), 6).alias("days_exact"),
    )


def _derived_columns(spark, sf_dir):
    """Value map, banding, decision, default, safe ratio, status class."""
    levels = {"click": 1, "view": 2, "purchase": 3}
    log = request_log(spark, sf_dir).join(
        events(spark, sf_dir).select(F.col("event_id").alias("request_id"), "event_type", "k"), "request_id"
    )
    return log.select(
        "request_id",
        fx.map_values("event_type", levels).cast("double").alias("level"),
        fx.band("k", [0, 18, 36, 60, 72], ["0-18", "18-36", "36-60", "60-72"]).alias("k_band"),
        fx.decide("duration_ms", F.lit(50.0), "slow", "fast").alias("speed"),
        F.coalesce("insert_ms", F.lit(0.0)).alias("insert_or_zero"),
        F.round(fx.ratio("duration_ms", F.col("k")), 9).alias("per_k"),
        fx.status_class("status_code").alias("status_class"),
        fx.nan_to_null("duration_ms").alias("duration_ms"),
    )


def _tagged(spark, sf_dir):
    ev = events(spark, sf_dir)
    tagged = union_tagged(
        {t: ev.filter(F.col("event_type") == t).select("event_id", "k") for t in EVENT_TYPES},
        "kind",
    )
    return tagged.groupBy("kind").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"))


QUERIES = {
    "parse_numbers": _parse_numbers,
    "event_calendar": _calendar,
    "derived_columns": _derived_columns,
    "traffic_scan": lambda s, d: rounded(
        read_traffic(predictions(s, d), ["value", "k", "event_type"]), 9
    ),
    "prediction_keys_scan": lambda s, d: read_prediction_keys(predictions(s, d)),
    "time_range_scan": lambda s, d: between(
        table(s, d, "events"),
        "ts",
        F.lit("2024-01-08").cast("timestamp_ntz"),
        F.lit("2024-01-15").cast("timestamp_ntz"),
    ).select("event_id", "ts", "event_type"),
    "union_tagged": _tagged,
    "first_rows": lambda s, d: sample_first(
        rounded(predictions(s, d).select("request_id", "value", "k", "event_type", "probability"), 9),
        "request_id",
        50,
    ),
    "rename_columns": lambda s, d: predictions(s, d)
    .select("request_id", "prediction", "event_time")
    .withColumnsRenamed({"request_id": "id", "prediction": "answer"}),
}

ORACLES = {
    "parse_numbers": f"""WITH {EVENTS},
        texts AS (
            SELECT event_id, event_id % 5 AS kind,
                   CASE event_id % 5 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN '  '
                        WHEN 2 THEN ' ' || CAST(k AS VARCHAR) || '.50 '
                        WHEN 3 THEN CAST(k AS VARCHAR) || 'd' ELSE 'n/a' END AS t
            FROM ev)
        SELECT event_id, TRY_CAST(trim(t) AS DOUBLE) AS number,
               coalesce(TRY_CAST(trim(t) AS DOUBLE), 0.0) AS number_or_zero,
               CASE WHEN kind <= 2 AND trim(t) <> '' THEN CAST(trim(t) AS DOUBLE) END AS blank_is_null
        FROM texts""",
    "event_calendar": f"""WITH {PREDICTIONS}, {OUTCOME_LABELS}
        SELECT request_id, CAST(event_time AS DATE) AS day,
               CAST(date_trunc('week', event_time) AS DATE) AS week,
               event_time + to_days(k) AS plus_k_days,
               CAST(available_at AS DATE) - CAST(event_time AS DATE) AS days_between,
               round(epoch(available_at - event_time) / 86400.0, 6) AS days_exact
        FROM predictions JOIN outcome_labels USING (request_id)""",
    "derived_columns": f"""WITH {REQUEST_LOG}
        SELECT r.request_id,
               CAST(CASE e.event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END AS DOUBLE) AS level,
               CASE WHEN k < 0 THEN NULL WHEN k <= 18 THEN '0-18' WHEN k <= 36 THEN '18-36'
                    WHEN k <= 60 THEN '36-60' WHEN k <= 72 THEN '60-72' END AS k_band,
               CASE WHEN duration_ms >= 50 THEN 'slow' ELSE 'fast' END AS speed,
               coalesce(insert_ms, 0.0) AS insert_or_zero,
               round(duration_ms / nullif(k, 0), 9) AS per_k,
               CAST(status_code // 100 AS INTEGER) AS status_class, duration_ms
        FROM request_log r JOIN ev e ON e.event_id = r.request_id""",
    "traffic_scan": f"""WITH {PREDICTIONS}
        SELECT CAST(event_time AS DATE) AS day, round(probability, 9) AS score, round(value, 9) AS value,
               k, event_type FROM predictions""",
    "prediction_keys_scan": f"WITH {PREDICTIONS} SELECT request_id, customer_id, event_time FROM predictions",
    "time_range_scan": """SELECT event_id, ts, event_type FROM events
        WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'""",
    "union_tagged": f"""WITH {EVENTS}
        SELECT event_type AS kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k
        FROM ev GROUP BY 1""",
    "first_rows": f"""WITH {PREDICTIONS}
        SELECT request_id, round(value, 9) AS value, k, event_type, round(probability, 9) AS probability
        FROM predictions ORDER BY request_id LIMIT 50""",
    "rename_columns": f"""WITH {PREDICTIONS}
        SELECT request_id AS id, prediction AS answer, event_time FROM predictions""",
}
