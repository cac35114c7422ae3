"""Validated joins, as-of label visibility and row parity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.operators.checks import CheckFailed, require_no_nulls
from modelwatch.operators.parity import parity_offenders


def key_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: most rows per key on either side, and keys without a partner.

    Everything a validated join has to know, from one shuffle of the keys alone; counts
    combine map-side, so a key with very many rows is one row per task.
    """
    keys = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(
        right.select(key, F.lit(0), F.lit(1))
    )
    return (
        keys.groupBy(key)
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
        .agg(
            F.coalesce(F.max("_l"), F.lit(0)).alias("max_left"),
            F.coalesce(F.max("_r"), F.lit(0)).alias("max_right"),
            # A null key never finds a partner, on whichever side it is.
            F.count_if((F.col("_l") > 0) & ((F.col("_r") == 0) | F.col(key).isNull())).alias("left_only"),
            F.count_if((F.col("_r") > 0) & ((F.col("_l") == 0) | F.col(key).isNull())).alias("right_only"),
        )
    )


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join whose key is unique on both sides and which must keep every left row."""
    match = key_match(left, right, key).first()
    if match["max_left"] > 1 or match["max_right"] > 1:
        raise CheckFailed(f"{key} is not unique: {match.asDict()}")
    if match["left_only"]:
        raise CheckFailed(f"{match['left_only']} rows found no partner on {key}")
    return left.join(right, key, "inner")


def attach_truth(
    predictions: DataFrame,
    truth: DataFrame,
    truth_key: str,
    prediction_key: str,
    label: str,
    as_name: str = "label",
) -> DataFrame:
    """Left join many predictions to one truth row each; every prediction must find one.

    A customer holding a large share of the predictions is split by the skew handling of
    adaptive execution: the truth side has one row per key, so copying it is free.
    """
    wanted = truth.select(truth_key, label).withColumnsRenamed(
        {truth_key: prediction_key, label: as_name}
    )
    match = key_match(predictions, wanted, prediction_key).first()
    if match["max_right"] > 1:
        raise CheckFailed(f"truth: {truth_key} is not unique")
    if match["left_only"]:
        raise CheckFailed(f"{match['left_only']} values of {prediction_key} have no truth")
    require_no_nulls(wanted, [as_name])
    return predictions.join(wanted, prediction_key, "left")


def asof_labels(
    predictions: DataFrame,
    labels: DataFrame,
    as_of: Column,
    key: str = "request_id",
    how: str = "inner",
) -> DataFrame:
    """Predictions with their label and `revealed`: was it known at `as_of`?

    how='left' keeps predictions whose label row has not been written yet.
    """
    joined = predictions.join(labels.select(key, "label", "available_at"), key, how)
    return joined.withColumn(
        "revealed", F.coalesce(F.col("available_at") <= as_of, F.lit(False))
    )


def row_parity(
    actual: DataFrame,
    expected: DataFrame,
    key: str,
    columns: Mapping[str, str],
    tolerance: float = 1e-9,
) -> DataFrame:
    """Rows whose values differ by more than the absolute tolerance, or lack a partner.

    `columns` maps actual to expected column names. Digests are compared first, see `operators.parity`.
    """
    return parity_offenders(actual, expected, key, columns, tolerance)


def require_parity(
    actual: DataFrame,
    expected: DataFrame,
    key: str,
    columns: Mapping[str, str],
    tolerance: float = 1e-9,
    show: int = 5,
) -> None:
    """Raise, naming a few offending keys, unless every row is reproduced."""
    offenders = row_parity(actual, expected, key, columns, tolerance)
    first = [r[0] for r in offenders.select(key).orderBy(key).limit(show).collect()]
    if first:
        raise CheckFailed(f"{offenders.count()} rows differ; first offenders: {first}")


def union_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union by name, every frame carrying its own literal tag."""
    result: DataFrame | None = None
    for value, frame in frames.items():
        part = frame.withColumn(tag, F.lit(value))
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError("nothing to union")
    return result
