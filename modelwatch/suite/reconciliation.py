"""Late-label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.functions.columns import plus_days
from modelwatch.operators import reconcile as op
from modelwatch.operators.joins import asof_labels
from modelwatch.sources.derived import (
    POSITIVE,
    events,
    order_labels,
    order_predictions,
    outcome_labels,
    predictions,
)
from modelwatch.suite.common import EVENTS, ORDER_FACTS, OUTCOME_LABELS, PREDICTIONS


def _outcomes(spark, sf_dir):
    """Observed outcomes; those later than the observation window do not count."""
    return events(spark, sf_dir).filter("k < 30").select(
        F.col("event_id").alias("request_id"),
        plus_days("ts", 1 + F.col("event_id") % 120).alias("outcome_at"),
    )


def _both(spark, sf_dir):
    return predictions(spark, sf_dir), outcome_labels(spark, sf_dir)


QUERIES = {
    "reconcile_vantage": lambda s, d: op.cohort_by_vantage(*_both(s, d), POSITIVE, places=6),
    "reconcile_vantage_orders": lambda s, d: op.cohort_by_vantage(
        order_predictions(s, d), order_labels(s, d), POSITIVE,
        days_after=(0, 90, 365, 1000, 2000), start_day=0, end_day=730, how="left", places=6,
    ),
    "reconcile_weekly": lambda s, d: op.weekly_cohorts(*_both(s, d), POSITIVE, places=6),
    "reconcile_weekly_orders": lambda s, d: op.weekly_cohorts(
        order_predictions(s, d), order_labels(s, d), POSITIVE, days_after=-700, how="left", places=6
    ),
    "reconcile_mature": lambda s, d: op.mature_quality(*_both(s, d), POSITIVE, places=6),
    "asof_labels": lambda s, d: asof_labels(
        order_predictions(s, d), order_labels(s, d), F.lit("1999-01-01").cast("timestamp_ntz"), how="left"
    ).withColumn("label", F.col("label").cast("double")),
    "label_delay": lambda s, d: op.label_delay(*_both(s, d), places=6),
    "labels_available": lambda s, d: op.labels_available(*_both(s, d)),
    "mature_labels": lambda s, d: op.mature_labels(predictions(s, d), _outcomes(s, d)).withColumn(
        "label", F.col("label").cast("int")
    ),
    "quality_by_week": lambda s, d: op.weekly_cohorts(
        *_both(s, d), POSITIVE, days_after=90, places=6
    ).select("prediction_week", "coverage_pct", "precision", "recall"),
}


def _measures(source: str, group: str) -> str:
    """Quality measures over a CTE with 0/1 columns r (revealed), f (flagged), y (label)."""
    return f"""SELECT {group}, count(*) AS n_predictions, CAST(sum(r) AS BIGINT) AS n_labelled,
           round(100 * sum(r) / CAST(count(*) AS DOUBLE), 4) AS coverage_pct,
           round(sum(r * y) / CAST(nullif(sum(r), 0) AS DOUBLE), 6) AS labelled_positive_rate,
           round(sum(r * f * y) / CAST(nullif(sum(r * f), 0) AS DOUBLE), 6) AS precision,
           round(sum(r * f * y) / CAST(nullif(sum(r * y), 0) AS DOUBLE), 6) AS recall
    FROM {source} GROUP BY {group}"""


def _flags(as_of: str) -> str:
    return f"""CAST(coalesce(l.available_at <= CAST({as_of} AS TIMESTAMP), FALSE) AS INTEGER) AS r,
               CAST(p.prediction = 'positive' AS INTEGER) AS f, coalesce(l.label, 0) AS y"""


def _vantage(preds: str, labels: str, days: str, start: int, end: int, join: str) -> str:
    return f"""origin AS (SELECT CAST(min(event_time) AS DATE) AS d0 FROM {preds}),
    points AS (SELECT unnest([{days}]) AS days_after_week),
    judged AS (
        SELECT days_after_week, d0 + {end} + days_after_week AS as_of, {_flags(f'd0 + {end} + days_after_week')}
        FROM origin, points, {preds} p {join} JOIN {labels} l USING (request_id)
        WHERE p.event_time >= d0 + {start} AND p.event_time < d0 + {end})
    {_measures('judged', 'days_after_week, as_of')}"""


def _weekly(preds: str, labels: str, days: int, join: str) -> str:
    return f"""final AS (SELECT CAST(max(event_time) AS DATE) + ({days}) AS as_of FROM {preds}),
    judged AS (
        SELECT CAST(date_trunc('week', p.event_time) AS DATE) AS prediction_week, {_flags('as_of')}
        FROM final, {preds} p {join} JOIN {labels} l USING (request_id))
    {_measures('judged', 'prediction_week')}"""


_EVENT_FACTS = f"WITH {PREDICTIONS}, {OUTCOME_LABELS}"

ORACLES = {
    "reconcile_vantage": f"{_EVENT_FACTS}, "
    + _vantage("predictions", "outcome_labels", "7, 21, 45, 70, 90, 120", 7, 14, "INNER"),
    "reconcile_vantage_orders": f"WITH {ORDER_FACTS}, "
    + _vantage("order_predictions", "order_labels", "0, 90, 365, 1000, 2000", 0, 730, "LEFT"),
    "reconcile_weekly": f"{_EVENT_FACTS}, " + _weekly("predictions", "outcome_labels", 45, "INNER"),
    "reconcile_weekly_orders": f"WITH {ORDER_FACTS}, "
    + _weekly("order_predictions", "order_labels", -700, "LEFT"),
    "reconcile_mature": f"""{_EVENT_FACTS},
        origin AS (SELECT CAST(min(event_time) AS DATE) AS d0 FROM predictions),
        judged AS (
            SELECT if(event_time < d0 + 20, 'baseline', 'ramp') AS period, label AS y,
                   CAST(prediction = 'positive' AS INTEGER) AS f
            FROM origin, predictions JOIN outcome_labels USING (request_id))
        SELECT period, count(*) AS n, round(sum(y) / CAST(count(*) AS DOUBLE), 6) AS prevalence,
               round(sum(f * y) / CAST(nullif(sum(f), 0) AS DOUBLE), 6) AS precision,
               round(sum(f * y) / CAST(nullif(sum(y), 0) AS DOUBLE), 6) AS recall
        FROM judged GROUP BY period""",
    "asof_labels": f"""WITH {ORDER_FACTS}
        SELECT p.request_id, event_time, prediction, CAST(label AS DOUBLE) AS label, available_at,
               coalesce(available_at <= TIMESTAMP '1999-01-01', FALSE) AS revealed
        FROM order_predictions p LEFT JOIN order_labels l ON l.request_id = p.request_id""",
    "label_delay": f"""{_EVENT_FACTS},
        delays AS (SELECT label, epoch(available_at - event_time) / 86400.0 AS days
                   FROM outcome_labels JOIN predictions USING (request_id))
        SELECT label, count(*) AS n, round(min(days), 6) AS min_days, round(avg(days), 6) AS avg_days,
               round(max(days), 6) AS max_days FROM delays GROUP BY 1""",
    "labels_available": f"""{_EVENT_FACTS}
        SELECT label, count(*) AS available FROM outcome_labels
        WHERE available_at <= (SELECT min(event_time) FROM predictions) + INTERVAL 60 DAY GROUP BY 1""",
    "mature_labels": f"""WITH {EVENTS},
        dated AS (SELECT event_id, ts, k, 1 + event_id % 120 AS delay FROM ev)
        SELECT event_id AS request_id, CASE WHEN k < 30 AND delay <= 90 THEN 1 ELSE 0 END AS label,
               ts + to_days(CAST(CASE WHEN k < 30 AND delay <= 90 THEN delay ELSE 90 END AS INTEGER)) AS available_at
        FROM dated""",
    "quality_by_week": f"{_EVENT_FACTS}, week_quality AS (WITH "
    + _weekly("predictions", "outcome_labels", 90, "INNER")
    + ") SELECT prediction_week, coverage_pct, precision, recall FROM week_quality",
}
