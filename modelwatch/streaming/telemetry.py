"""Streaming telemetry: windowed latency histograms, rates and error ratios.

State per (window, path) is one row of counts. Exact percentiles never enter the state:
they cannot be merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.columns import ratio, status_class
from modelwatch.operators.latency import SECONDS, bucket_counts, bucket_rows
from modelwatch.schemas import LATENCY_BUCKETS


def with_event_time(stream: DataFrame, column: str) -> DataFrame:
    """Watermarks need a zoned timestamp; wall-clock values are read as session time."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def windowed_histogram(
    log: DataFrame,
    window: str,
    delay: str,
    time: str = "created_at",
    seconds: str = SECONDS,
    bounds: Sequence[float] = LATENCY_BUCKETS,
) -> DataFrame:
    """(bucket, path, le_ord, le, cum) per closed window."""
    counted = (
        with_event_time(log, time)
        .withWatermark(time, delay)
        .groupBy(F.window(time, window), "path")
        .agg(*bucket_counts(seconds, bounds))
        .withColumn("bucket", F.col("window.start").cast("timestamp_ntz"))
    )
    return bucket_rows(counted, ["bucket", "path"], bounds)


def windowed_service_rates(
    log: DataFrame, window: str, seconds: int, delay: str, time: str = "created_at"
) -> DataFrame:
    """Requests per second and error ratios per closed window and path."""
    cls = status_class("status_code")
    counted = (
        with_event_time(log, time)
        .withWatermark(time, delay)
        .groupBy(F.window(time, window), "path")
        .agg(
            F.count("*").alias("n"),
            F.count_if(cls == 4).alias("_client"),
            F.count_if(cls == 5).alias("_server"),
        )
    )
    return counted.select(
        F.col("window.start").cast("timestamp_ntz").alias("bucket"),
        "path",
        (F.col("n") / F.lit(float(seconds))).alias("per_second"),
        ratio("_client", "n").alias("client_error_ratio"),
        ratio("_server", "n").alias("server_error_ratio"),
    )
