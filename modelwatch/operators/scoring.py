"""Batch scoring with a fitted model, and the decision record."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.functions.columns import decide, default_id, default_time
from modelwatch.operators.contract import Contract, split_valid, validate


def predict_scores(model: PipelineModel, df: DataFrame, score: str = "score") -> DataFrame:
    """Add the probability of class 1. A narrow stage; columns are found by name."""
    scored = model.transform(df).withColumn(score, vector_to_array("probability")[1])
    return scored.select(*df.columns, score)


def score_foreign(
    df: DataFrame,
    predict: Callable[[pd.DataFrame], Sequence[float]],
    features: Sequence[str],
    score: str = "score",
) -> DataFrame:
    """Score with a model that is not a Spark one, batch by batch over Arrow."""
    names = list(features)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{score: np.asarray(predict(frame[names]), dtype=float)})

    schema = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())])
    return df.mapInPandas(batches, schema)


def decisions(
    scored: DataFrame,
    threshold: float,
    version: str,
    positive: str,
    negative: str,
    score: str = "score",
    now: Column | None = None,
) -> DataFrame:
    """Prediction facts: what was answered, by which version, under which threshold."""
    created = now if now is not None else F.current_timestamp()
    others = [c for c in scored.columns if c not in (score, "event_time")]
    return scored.select(
        *others,
        decide(score, F.lit(float(threshold)), positive, negative).alias("prediction"),
        F.lit(float(threshold)).alias("threshold"),
        F.col(score).alias("probability"),
        F.lit(str(version)).alias("model_version"),
        created.alias("created_at"),
        default_time("event_time", now).alias("event_time"),
    )


def identify(requests: DataFrame, position: Column | str = "position") -> DataFrame:
    """Give records without a request_id one, from what they say and where they were read."""
    named = position if isinstance(position, str) else None
    record = [c for c in requests.columns if c not in ("request_id", named)]
    given = F.col("request_id") if "request_id" in requests.columns else F.lit(None).cast("string")
    place = F.col(position) if named else position
    identified = requests.withColumn("request_id", default_id(given, record, place))
    return identified.drop(named) if named else identified


def score_requests(
    requests: DataFrame,
    model: PipelineModel,
    threshold: float,
    version: str,
    contract: Contract,
    positive: str = "churn",
    negative: str = "no_churn",
    now: Column | None = None,
    position: Column | str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Validate, give ids, score, decide: (prediction facts, quarantined records).

    The same function serves batches and streams; the valid side has no shuffle. `position` tells
    equal records without an id apart: an expression, or the name of a column of `requests` such as
    `sources.files.with_position` adds, which makes a file that is read again give the same ids. By
    default every call gives ids of its own.
    """
    valid, quarantine = split_valid(validate(requests, contract, now))
    if "event_time" not in valid.columns:
        valid = valid.withColumn("event_time", F.lit(None).cast("timestamp"))
    # Row numbers start again with every batch, so they are told apart by a number of the batch.
    if position is None:
        batch = F.lit(uuid.uuid4().hex)
        position = F.uuid() if valid.isStreaming else F.concat_ws("#", batch, F.monotonically_increasing_id())
    identified = identify(valid, position)
    facts = decisions(predict_scores(model, identified), threshold, version, positive, negative, now=now)
    return facts, quarantine


def responses(facts: DataFrame) -> DataFrame:
    """The answer records."""
    return facts.select(
        "request_id",
        "customer_id",
        "prediction",
        "threshold",
        "probability",
        F.col("model_version").cast("int").alias("model_version"),
    )
