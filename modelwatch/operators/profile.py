"""Exploratory profiles: describe per class, segment shares and rates, banded profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.columns import band, percent, unpivot_columns
from modelwatch.operators.ordering import exact_percentiles


def grouped_describe(
    df: DataFrame, by: str, columns: Sequence[str]
) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles per (group, column)."""
    long = df.select(
        by, unpivot_columns({c: F.col(c).cast("double") for c in columns}, "column_name", "x")
    ).filter(F.col("x").isNotNull())
    keys = [by, "column_name"]
    moments = long.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    quartiles = exact_percentiles(
        long, "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by=keys, kind="linear"
    ).drop("n")
    return moments.join(quartiles, keys)


def grouped_non_null_counts(df: DataFrame, by: str) -> DataFrame:
    """Non-null count of every other column per group."""
    return df.groupBy(by).agg(*[F.count(c).alias(c) for c in df.columns if c != by])


def segment_profile(df: DataFrame, segment: Column, name: str, positive: Column) -> DataFrame:
    """Share of all rows, share of all positives and positive rate (percent) per segment."""
    grouped = df.groupBy(segment.alias(name)).agg(
        F.count("*").alias("n"), F.count_if(positive).alias("n_positive")
    )
    totals = grouped.agg(F.sum("n").alias("_n"), F.sum("n_positive").alias("_pos"))
    return grouped.crossJoin(F.broadcast(totals)).select(  # one row of totals
        name,
        "n",
        percent("n", "_n").alias("pct_of_total"),
        percent("n_positive", "_pos").alias("pct_of_positives"),
        percent("n_positive", "n").alias("positive_pct"),
    )


def banded_profile(
    df: DataFrame,
    column: str,
    edges: Sequence[float],
    labels: Sequence[str],
    positive: Column,
    name: str = "band",
) -> DataFrame:
    """Segment profile over right-closed bands; shares are of all rows, empty bands are absent."""
    profile = segment_profile(df, band(column, edges, labels), name, positive)
    # As generated rows: pushed further down, the filter would split the shared aggregate
    # into two scans, one with and one without the rows outside the bands.
    rows = F.inline(F.array(F.struct(*profile.columns)))
    return profile.select(rows).filter(F.col(name).isNotNull())


def rate_of(df: DataFrame, condition: Column, name: str = "rate_pct") -> DataFrame:
    """Percent of rows meeting a condition."""
    return df.agg((F.lit(100.0) * F.avg(condition.cast("double"))).alias(name))


def sample_first(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the lowest keys: a top-k, not a full sort."""
    return df.orderBy(key).limit(n)
