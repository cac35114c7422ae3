"""Labels joined to predictions as both come in, however late and in whatever order.

A watermarked stream join drops rows behind its watermark without a word. Here each micro-batch is
stored beside the earlier ones, in folders by day, and joined with what is stored: its predictions
with all labels, its labels with the earlier predictions. A label may follow its prediction by the
observation period, so only folders of that period around the batch's own days are read. No row
is dropped for being late and nothing is kept in memory between micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import DateType, LongType, StructField, StructType

from modelwatch.session import materialise
from modelwatch.streaming.telemetry import with_event_time

BATCH, DAY = "batch_id", "day"


def _side(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """Stored rows of one side, of micro-batches before the given one."""
    fields = [*schema.fields, StructField(BATCH, LongType()), StructField(DAY, DateType())]
    rows = spark.read.schema(StructType(fields)).option("basePath", path).parquet(path)
    return rows if before is None else rows.filter(F.col(BATCH) < before)


def _store(rows: DataFrame, path: str, batch_id: int, time: str) -> None:
    dated = rows.withColumn(DAY, F.to_date(time)).hint("rebalance", F.col(DAY))
    dated.write.mode("overwrite").partitionBy(DAY).parquet(f"{path}/{BATCH}={batch_id}")


def _days(rows: DataFrame, time: str):
    return rows.agg(F.min(F.to_date(time)), F.max(F.to_date(time))).first()


def store_label_join(
    predictions: DataFrame,
    labels: DataFrame,
    path: str,
    checkpoint: str,
    observation_days: int = 90,
    key: str = "request_id",
    time: str = "event_time",
) -> DataStreamWriter:
    """Writes each prediction with its label under `path`, when the later of both has come.

    predictions: (key, time, prediction); labels: (key, label, available_at), joined where the label
    comes from the prediction's time on and within the observation period. A micro-batch that is
    repeated after a failure replaces what it wrote before. Ids are expected once on each side.
    """
    p = with_event_time(predictions, time).select(key, time, "prediction")
    lab = with_event_time(labels, "available_at").select(key, "label", "available_at")
    both = p.withColumn("is_label", F.lit(False)).unionByName(
        lab.withColumn("is_label", F.lit(True)), allowMissingColumns=True
    )
    period = F.expr(f"INTERVAL {int(observation_days)} DAYS")

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed(key, "_key")
        in_time = (F.col("available_at") >= F.col(time)) & (F.col("available_at") <= F.col(time) + period)
        return left.join(right, (F.col(key) == F.col("_key")) & in_time).select(
            key, time, "prediction", "label", "available_at"
        )

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialise(batch)
        new_p = batch.filter(~F.col("is_label")).select(p.columns)
        new_l = batch.filter("is_label").select(lab.columns)
        _store(new_p, f"{path}/predictions", batch_id, time)
        _store(new_l, f"{path}/labels", batch_id, "available_at")
        out = joined(new_p, new_l)
        first, last = _days(new_p, time)
        if first is not None and batch_id:
            near = F.col(DAY).between(F.lit(first), F.date_add(F.lit(last), observation_days + 1))
            old = _side(spark, f"{path}/labels", lab.schema, batch_id).filter(near).select(lab.columns)
            out = out.unionByName(joined(new_p, old))
        first, last = _days(new_l, "available_at")
        if first is not None and batch_id:
            near = F.col(DAY).between(F.date_sub(F.lit(first), observation_days + 1), F.lit(last))
            old = _side(spark, f"{path}/predictions", p.schema, batch_id).filter(near).select(p.columns)
            out = out.unionByName(joined(old, new_l))
        out.write.mode("overwrite").parquet(f"{path}/joined/{BATCH}={batch_id}")

    return both.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)


def read_label_join(spark: SparkSession, path: str) -> DataFrame:
    """All predictions joined with their labels so far."""
    return spark.read.parquet(f"{path}/joined").drop(BATCH)


def unanswered(
    spark: SparkSession, path: str, as_of, observation_days: int = 90, key: str = "request_id", time: str = "event_time"
) -> DataFrame:
    """Stored predictions whose observation period ended before `as_of` without a label: (key, time, prediction)."""
    stored = spark.read.option("basePath", f"{path}/predictions").parquet(f"{path}/predictions").drop(BATCH, DAY)
    closed = stored.filter(F.col(time) + F.expr(f"INTERVAL {int(observation_days)} DAYS") < as_of)
    return closed.join(read_label_join(spark, path).select(key), key, "left_anti")
