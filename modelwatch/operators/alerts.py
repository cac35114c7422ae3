"""Noise floor, alert lines and detection days over the small drift_metrics table.

Its size is days x features x windows, whatever the traffic, so plain aggregates per
series are enough here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.functions.columns import ratio, round_half_up, whole_days

QUIET_DAYS = 20
SERIES = ["feature", "window_days"]


def period_of(time: Column, boundary: Column) -> Column:
    return F.when(time < boundary, F.lit("baseline")).otherwise(F.lit("ramp"))


def with_period(metrics: DataFrame, quiet_days: int = QUIET_DAYS) -> DataFrame:
    """Label each day baseline or ramp; the ramp starts `quiet_days` after the first day."""
    bounds = metrics.agg(F.date_add(F.min("day"), quiet_days).alias("ramp_start"))
    return (
        metrics.crossJoin(F.broadcast(bounds))  # one row
        .withColumn("period", period_of(F.col("day"), F.col("ramp_start")))
    )


def _disc(q: float, column: str, condition: str | None = None) -> Column:
    where = f" FILTER (WHERE {condition})" if condition else ""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column}){where}")


def _line(p50: Column, p95: Column) -> Column:
    return p50 + F.lit(3) * (p95 - p50)


def alert_lines(metrics: DataFrame, quiet_days: int = QUIET_DAYS) -> DataFrame:
    """(feature, window_days, alert_at): p50 + 3 (p95 - p50) of the quiet period."""
    quiet = with_period(metrics, quiet_days).filter("period = 'baseline'")
    return (
        quiet.groupBy(*SERIES)
        .agg(_disc(0.5, "psi").alias("p50"), _disc(0.95, "psi").alias("p95"))
        .select(*SERIES, _line(F.col("p50"), F.col("p95")).alias("alert_at"))
    )


def noise_floor(metrics: DataFrame, quiet_days: int = QUIET_DAYS, places: int = 4) -> DataFrame:
    """Quiet and shifted PSI side by side per series, widest separation first."""
    quiet, shifted = "period = 'baseline'", "period = 'ramp'"
    agg = with_period(metrics, quiet_days).groupBy(*SERIES).agg(
        _disc(0.5, "psi", quiet).alias("baseline_p50"),
        _disc(0.95, "psi", quiet).alias("baseline_p95"),
        F.max(F.when(F.expr(quiet), F.col("psi"))).alias("baseline_max"),
        _disc(0.5, "psi", shifted).alias("ramp_p50"),
        F.max(F.when(F.expr(shifted), F.col("psi"))).alias("ramp_max"),
    )
    return agg.select(
        *SERIES,
        round_half_up("baseline_p50", places).alias("baseline_p50"),
        round_half_up("baseline_p95", places).alias("baseline_p95"),
        round_half_up("baseline_max", places).alias("baseline_max"),
        round_half_up(_line(F.col("baseline_p50"), F.col("baseline_p95")), places).alias("alert_at"),
        round_half_up("ramp_p50", places).alias("ramp_p50"),
        round_half_up("ramp_max", places).alias("ramp_max"),
        round_half_up(ratio("ramp_p50", "baseline_max"), max(places - 2, 2)).alias("separation"),
    ).orderBy(F.desc_nulls_last("separation"), "feature", "window_days")


def chi_square_floor(metrics: DataFrame, bins_per_feature: DataFrame) -> DataFrame:
    """Expected PSI of sampling noise, (bins - 1) / rows of the window, next to the measured one."""
    return metrics.join(bins_per_feature, "feature").withColumn(
        "noise_floor", (F.col("n_bins") - F.lit(1)).cast("double") / F.col("n_rows")
    )


def daily_share(facts: DataFrame, time: str, condition: Column, name: str = "shifted_share") -> DataFrame:
    """Share of each day's rows that meet a condition."""
    return facts.groupBy(F.to_date(time).alias("day")).agg(
        F.avg(condition.cast("double")).alias(name)
    )


def detections(
    metrics: DataFrame,
    quiet_days: int = QUIET_DAYS,
    daily_mix: DataFrame | None = None,
    places: int = 4,
) -> DataFrame:
    """First crossing of each series' line; series that never cross are absent.

    A crossing in the quiet period counts as a false alarm and also as the alert day.
    """
    lines = alert_lines(metrics, quiet_days)
    crossings = (
        with_period(metrics, quiet_days)
        .join(lines, SERIES)
        .filter(F.col("psi") >= F.col("alert_at"))
        .groupBy(*SERIES, "alert_at")
        .agg(
            F.min("day").alias("alert_day"),
            F.count_if(F.col("period") == "baseline").alias("false_alarms"),
        )
    )
    first = metrics.agg(F.min("day").alias("first_day"))
    found = crossings.crossJoin(F.broadcast(first))  # one row
    columns = [
        *SERIES,
        round_half_up("alert_at", places).alias("alert_at"),
        "false_alarms",
        "alert_day",
        whole_days("alert_day", "first_day").alias("day_index"),
    ]
    if daily_mix is not None:
        mix = daily_mix.select(F.col("day").alias("alert_day"), "shifted_share")
        found = found.join(mix, "alert_day", "left")
        columns.append(
            round_half_up(F.lit(100) * F.col("shifted_share"), max(places - 3, 1)).alias("shifted_pct_that_day")
        )
    return found.select(*columns).orderBy("window_days", "alert_day", "feature")


def metrics_with_line(metrics: DataFrame, quiet_days: int = QUIET_DAYS) -> DataFrame:
    """Every PSI value next to its alert line and whether it crosses it."""
    return metrics.join(alert_lines(metrics, quiet_days), SERIES, "left").withColumn(
        "crossed", F.coalesce(F.col("psi") >= F.col("alert_at"), F.lit(False))
    )


def agreement(found: DataFrame) -> DataFrame:
    """Series newly crossed and crossed so far, per alert day and window length."""
    per_day = found.groupBy("window_days", "alert_day").agg(F.count("*").alias("n_new"))
    so_far = Window.partitionBy("window_days").orderBy("alert_day").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return per_day.withColumn("n_crossed", F.sum("n_new").over(so_far))
