"""Streaming facts: scored predictions, daily drift counts, label reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from modelwatch.operators.contract import Contract
from modelwatch.operators.drift import DriftReference, bin_generator
from modelwatch.operators.scoring import score_requests
from modelwatch.sinks.tables import append_predictions
from modelwatch.streaming.segments import read_segments, store_segment
from modelwatch.streaming.telemetry import with_event_time

PARTITIONS = "spark.sql.shuffle.partitions"
BATCH = "batch_id"


def score_stream(
    requests: DataFrame,
    model: PipelineModel,
    threshold: float,
    version: str,
    contract: Contract,
    now: Column | None = None,
    **answers: str,
) -> tuple[DataFrame, DataFrame]:
    """(prediction facts, quarantine) of a request stream, by the batch scoring function.

    Late requests are facts like others; `append_unseen` stores ids once.
    """
    return score_requests(requests, model, threshold, version, contract, now=now, **answers)


def store_scores(
    requests: DataFrame,
    model: PipelineModel,
    threshold: float,
    version: str,
    contract: Contract,
    predictions_path: str,
    quarantine_path: str,
    checkpoint: str,
    now: Column | None = None,
    **answers: str,
) -> DataStreamWriter:
    """Score a request stream; each micro-batch stores its facts and its rejected records.

    Records without an id get one from the micro-batch and the place in it, so a micro-batch that is
    repeated after a failure adds no fact twice; its rejected records replace those of the first try.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        position = F.concat_ws("-", F.lit(batch_id), F.monotonically_increasing_id())
        facts, quarantine = score_requests(
            batch, model, threshold, version, contract, now=now, position=position, **answers
        )
        append_predictions(facts, predictions_path)
        quarantine.write.mode("overwrite").parquet(f"{quarantine_path}/{BATCH}={batch_id}")

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)


def daily_bin_stream(
    traffic: DataFrame, reference: DriftReference, delay: str, time: str = "event_time"
) -> DataFrame:
    """(day, feature_id, bin, cnt) per day: the input of `drift.rolling_psi`."""
    return (
        with_event_time(traffic, time)
        .withWatermark(time, delay)
        .select(time, bin_generator(reference.numeric, reference.categorical))
        .groupBy(F.window(time, "1 day"), "feature_id", "bin")
        .agg(F.count("*").alias("cnt"))
        .select(F.to_date(F.col("window.start")).alias("day"), "feature_id", "bin", "cnt")
    )


def join_labels(
    predictions: DataFrame,
    labels: DataFrame,
    observation_days: int = 90,
    delay: str = "1 day",
    key: str = "request_id",
    time: str = "event_time",
) -> DataFrame:
    """Each prediction with its label, as the labels come in.

    A label may follow its prediction by the observation period; that bounds the state,
    which holds ids, decisions and times only.
    """
    p = with_event_time(predictions, time).withWatermark(time, delay).select(key, time, "prediction")
    lab = (
        with_event_time(labels, "available_at")
        .withWatermark("available_at", delay)
        .select(F.col(key).alias("_key"), "label", "available_at")
    )
    late = F.expr(
        f"available_at >= {time} AND available_at <= {time} + INTERVAL {int(observation_days)} DAYS"
    )
    return p.join(lab, (F.col(key) == F.col("_key")) & late).drop("_key")


def append_to(stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> DataStreamWriter:
    """Exactly-once append to Parquet; a failed write fails the micro-batch."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return writer.partitionBy(partition_by) if partition_by else writer


def upsert_to(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ()) -> DataStreamWriter:
    """Running results of a windowed aggregation: each micro-batch stores the rows that it changed.

    A window is there from its first row on, not only once the watermark has passed it. Micro-batches
    are kept as segments that are merged as they grow in number (see `segments`), by `keys` where given.
    `read_upserts` gives the newest state.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        store_segment(batch, batch_id, path, keys)

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)


def read_upserts(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key of a table written by `upsert_to`."""
    return read_segments(spark, path, schema, keys)


def append_unseen(
    stream: DataFrame, path: str, checkpoint: str, key: str = "request_id", time: str = "event_time"
) -> DataStreamWriter:
    """Append facts whose id is not stored yet, however late they come.

    Ids are compared with the stored ones of the same days instead of a watermarked state, so no
    row is dropped for being late and no state grows. A micro-batch that is repeated after a failure
    finds the rows of its first try and adds the others.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        append_predictions(batch, path, time)

    return (
        with_event_time(stream, time).writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    )


def run_available(writer: DataStreamWriter, state_partitions: int | None = None) -> StreamingQuery:
    """Process everything there is, then stop.

    The first run of a checkpoint fixes how many partitions its state has for good, so the
    number is given here, by the size of the state, rather than left to the session.
    """
    spark = SparkSession.getActiveSession()
    session_value = spark.conf.get(PARTITIONS)
    if state_partitions:
        spark.conf.set(PARTITIONS, state_partitions)
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(PARTITIONS, session_value)
    query.awaitTermination()
    return query
