"""Service and model dashboards: rates, errors, percentiles over time, daily series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.columns import day_of, ratio, status_class
from modelwatch.operators.latency import (
    SECONDS,
    bucket_counts,
    bucket_rows,
    histogram_quantile,
)
from modelwatch.operators.ordering import exact_percentiles
from modelwatch.schemas import LATENCY_BUCKETS


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "path", "status_code").agg(F.count("*").alias("n_requests"))


def time_bucket(time: Column | str, seconds: int) -> Column:
    """Start of the fixed-width interval holding `time`, counted from the epoch.

    Integer arithmetic on the wall-clock value: no time zone is involved.
    """
    t = F.col(time) if isinstance(time, str) else time
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    past = F.timestamp_diff("SECOND", epoch, t.cast("timestamp_ntz"))
    return F.timestamp_add("SECOND", past - F.pmod(past, F.lit(seconds)), epoch)


def request_rate(log: DataFrame, seconds: int, time: str = "created_at") -> DataFrame:
    """Requests per second by path and interval."""
    return (
        log.groupBy(time_bucket(time, seconds).alias("bucket"), "path")
        .agg(F.count("*").alias("_n"))
        .select("bucket", "path", (F.col("_n") / F.lit(float(seconds))).alias("per_second"))
    )


def error_ratio(log: DataFrame, seconds: int, time: str = "created_at") -> DataFrame:
    """Share of 4xx and 5xx answers per interval; 0 where there are none."""
    cls = status_class("status_code")
    return (
        log.groupBy(time_bucket(time, seconds).alias("bucket"))
        .agg(
            F.count("*").alias("_n"),
            F.count_if(cls == 4).alias("_client"),
            F.count_if(cls == 5).alias("_server"),
        )
        .select(
            "bucket",
            ratio("_client", "_n").alias("client_error_ratio"),
            ratio("_server", "_n").alias("server_error_ratio"),
        )
    )


def latency_over_time(
    log: DataFrame,
    seconds: int,
    quantiles: Mapping[str, float],
    path: str = "/predict",
    time: str = "created_at",
    bounds: Sequence[float] = LATENCY_BUCKETS,
    duration: str = SECONDS,
) -> DataFrame:
    """Estimated latency quantiles per interval for one path, from bucket counts only."""
    by = ["bucket"]
    aggregated = (
        log.filter(F.col("path") == path)
        .groupBy(time_bucket(time, seconds).alias("bucket"))
        .agg(*bucket_counts(duration, bounds))
    )
    return histogram_quantile(bucket_rows(aggregated, by, bounds), quantiles, by, bounds)


def predictions_daily(predictions: DataFrame, positive: str, time: str = "event_time") -> DataFrame:
    """Predictions and share of positive decisions per day."""
    return predictions.groupBy(day_of(time).alias("day")).agg(
        F.count("*").alias("n_predictions"),
        F.avg((F.col("prediction") == positive).cast("double")).alias("positive_share"),
    )


def score_quantiles_daily(
    predictions: DataFrame,
    quantiles: Mapping[str, float] | None = None,
    score: str = "probability",
    time: str = "event_time",
) -> DataFrame:
    """Exact p10, p50 and p90 of the score per day."""
    return exact_percentiles(
        predictions.select(day_of(time).alias("day"), score),
        score,
        quantiles or {"p10": 0.10, "p50": 0.50, "p90": 0.90},
        by=["day"],
    )
