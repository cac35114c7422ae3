"""Reconciliation of predictions with labels that arrive later.

The one large step is an equi-join on the prediction id, unique on both sides. After it
rows collapse map-side into a few cells (cohort, first moment known, decision, label), and
every as-of date is a running total over those cells, not another pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.columns import (
    day_of,
    fractional_days,
    percent,
    plus_days,
    ratio,
    round_half_up,
    sql_literal,
    week_of,
)
from modelwatch.operators.alerts import QUIET_DAYS, period_of
from modelwatch.operators.joins import asof_labels

VANTAGE_DAYS = (7, 21, 45, 70, 90, 120)
OBSERVATION_DAYS = 90


def event_days(predictions: DataFrame, time: str = "event_time") -> tuple[date | None, date | None]:
    """First and last event day: one row, fetched so that the filters become literals.

    As literals they reach the file scan and prune date folders; as several subqueries over
    the same table they would be merged into one struct and reach neither.
    """
    row = predictions.agg(day_of(F.min(time)).alias("first"), day_of(F.max(time)).alias("last")).first()
    return row["first"], row["last"]


def _midnight(day: date | None, like: DataFrame, column: str) -> Column:
    """Midnight of `day` in the type of `column`, so that comparing needs no cast of the column."""
    return F.lit(_iso(day)).cast(like.schema[column].dataType)


def _iso(day: date | None) -> str | None:
    return None if day is None else day.isoformat()


def _shift(day: date | None, days: int) -> date | None:
    return None if day is None else day + timedelta(days=days)


def in_days(
    predictions: DataFrame, time: str, start: date | None, end: date | None, folder: str = "event_date"
) -> DataFrame:
    """Rows of [start, end); a table kept in date folders also skips the other folders."""
    rows = predictions.filter(
        (F.col(time) >= _midnight(start, predictions, time))
        & (F.col(time) < _midnight(end, predictions, time))
    )
    if folder in predictions.columns:
        rows = rows.filter((F.col(folder) >= F.lit(start)) & (F.col(folder) < F.lit(end)))
    return rows


def _quality(weight: Column, revealed: Column, positive: Column, label: Column) -> dict[str, Column]:
    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, weight).otherwise(0))

    return {
        "n_predictions": F.sum(weight),
        "n_labelled": total(revealed),
        "_labelled_pos": total(revealed & (label == 1)),
        "_flagged": total(revealed & positive),
        "_hits": total(revealed & positive & (label == 1)),
    }


def _finish(counted: DataFrame, keys: Sequence, places: int) -> DataFrame:
    return counted.select(
        *keys,
        "n_predictions",
        "n_labelled",
        round_half_up(percent("n_labelled", "n_predictions"), max(places - 2, 1)).alias("coverage_pct"),
        round_half_up(ratio("_labelled_pos", "n_labelled"), places).alias("labelled_positive_rate"),
        round_half_up(ratio("_hits", "_flagged"), places).alias("precision"),
        round_half_up(ratio("_hits", "_labelled_pos"), places).alias("recall"),
    )


def cohort_by_vantage(
    predictions: DataFrame,
    labels: DataFrame,
    positive: str,
    days_after: Sequence[int] = VANTAGE_DAYS,
    start_day: int = 7,
    end_day: int = 14,
    key: str = "request_id",
    time: str = "event_time",
    how: str = "inner",
    places: int = 3,
) -> DataFrame:
    """One cohort, [start_day, end_day) after the first day, judged from several later dates."""
    points = sorted(days_after)
    first, _ = event_days(predictions, time)
    start, end = _shift(first, start_day), _shift(first, end_day)

    cohort = in_days(predictions, time, start, end).select(key, "prediction")
    joined = cohort.join(labels.select(key, "label", "available_at"), key, how)
    # Position of the first vantage point at which the label is known; null = after all.
    kind = labels.schema["available_at"].dataType.simpleString()
    known = F.expr(
        "CASE "
        + " ".join(
            f"WHEN available_at <= CAST({sql_literal(_iso(_shift(end, d)))} AS {kind}) THEN {i}"
            for i, d in enumerate(points)
        )
        + " END"
    )
    cells = joined.groupBy(
        known.alias("known_from"), (F.col("prediction") == positive).alias("positive"), "label"
    ).agg(F.count("*").alias("cnt"))

    vantage = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(points)]))
    expanded = cells.select("*", vantage.alias("v"))
    revealed = F.coalesce(F.col("known_from") <= F.col("v.i"), F.lit(False))
    counted = expanded.groupBy(F.col("v.d").alias("days_after_week")).agg(
        *[c.alias(n) for n, c in _quality(F.col("cnt"), revealed, F.col("positive"), F.col("label")).items()]
    )
    as_of = F.date_add(F.lit(end).cast("date"), F.col("days_after_week")).alias("as_of")
    return _finish(counted, ["days_after_week", as_of], places).orderBy("days_after_week")


def weekly_cohorts(
    predictions: DataFrame,
    labels: DataFrame,
    positive: str,
    days_after: int = 45,
    key: str = "request_id",
    time: str = "event_time",
    how: str = "inner",
    places: int = 3,
) -> DataFrame:
    """Every prediction week as known at one date, `days_after` the last event day."""
    _, last = event_days(predictions, time)
    as_of = _midnight(_shift(last, days_after), labels, "available_at")
    slim = predictions.select(
        key, week_of(time).alias("prediction_week"), (F.col("prediction") == positive).alias("positive")
    )
    judged = asof_labels(slim, labels, as_of, key, how)
    counted = judged.groupBy("prediction_week").agg(
        *[
            c.alias(n)
            for n, c in _quality(F.lit(1), F.col("revealed"), F.col("positive"), F.col("label")).items()
        ]
    )
    return _finish(counted, ["prediction_week"], places).orderBy("prediction_week")


def mature_quality(
    predictions: DataFrame,
    labels: DataFrame,
    positive: str,
    quiet_days: int = QUIET_DAYS,
    key: str = "request_id",
    time: str = "event_time",
    places: int = 3,
) -> DataFrame:
    """Prevalence, precision and recall with every label known, before and after the boundary."""
    first, _ = event_days(predictions, time)
    boundary = _midnight(_shift(first, quiet_days), predictions, time)
    slim = predictions.select(
        key, period_of(F.col(time), boundary).alias("period"), (F.col("prediction") == positive).alias("positive")
    )
    counted = slim.join(labels.select(key, "label"), key).groupBy("period").agg(
        F.count("*").alias("n"),
        F.avg(F.col("label").cast("double")).alias("_prevalence"),
        F.count_if(F.col("positive")).alias("_flagged"),
        F.count_if(F.col("label") == 1).alias("_positives"),
        F.count_if(F.col("positive") & (F.col("label") == 1)).alias("_hits"),
    )
    return counted.select(
        "period",
        "n",
        round_half_up("_prevalence", places).alias("prevalence"),
        round_half_up(ratio("_hits", "_flagged"), places).alias("precision"),
        round_half_up(ratio("_hits", "_positives"), places).alias("recall"),
    ).orderBy("period")


def label_delay(
    predictions: DataFrame,
    labels: DataFrame,
    key: str = "request_id",
    time: str = "event_time",
    places: int = 1,
) -> DataFrame:
    """Days from prediction to label, per class."""
    days = labels.select(key, "label", "available_at").join(predictions.select(key, time), key).select(
        "label", fractional_days("available_at", time).alias("days")
    )
    return days.groupBy("label").agg(
        F.count("*").alias("n"),
        round_half_up(F.min("days"), places).alias("min_days"),
        round_half_up(F.avg("days"), places).alias("avg_days"),
        round_half_up(F.max("days"), places).alias("max_days"),
    )


def labels_available(
    predictions: DataFrame, labels: DataFrame, days: int = 60, time: str = "event_time"
) -> DataFrame:
    """Labels known `days` after the first event, per class. The bound reaches the label scan."""
    bound = predictions.agg(
        plus_days(F.min(time), days).cast(labels.schema["available_at"].dataType).alias("bound")
    )
    return (
        labels.filter(F.col("available_at") <= bound.scalar())
        .groupBy("label")
        .agg(F.count("*").alias("available"))
    )


def mature_labels(
    predictions: DataFrame,
    outcomes: DataFrame,
    window_days: int = OBSERVATION_DAYS,
    key: str = "request_id",
    time: str = "event_time",
    outcome_time: str = "outcome_at",
) -> DataFrame:
    """(request_id, label, available_at) from observed outcomes.

    A positive is known when its outcome happens within the window; everything else is
    negative, and known only when the window closes. Several outcomes of one prediction
    are reduced to the earliest one that lies in the window.
    """
    p = predictions.select(key, time)
    close = plus_days(time, window_days)
    hits = (
        outcomes.select(key, outcome_time)
        .join(p, key)
        .filter((F.col(outcome_time) >= F.col(time)) & (F.col(outcome_time) <= close))
        .groupBy(key)
        .agg(F.min(outcome_time).alias("_hit"))
    )
    return p.join(hits, key, "left").select(
        key,
        F.when(F.col("_hit").isNotNull(), 1).otherwise(0).cast("short").alias("label"),
        F.coalesce("_hit", close).alias("available_at"),
    )
