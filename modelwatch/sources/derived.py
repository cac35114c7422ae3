"""The monitoring tables, derived from the star-schema test tables.

Every derivation is plain arithmetic, so that a SQL engine can repeat it exactly; the
SQL twins are in `suite.common`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.functions.columns import decide, plus_days
from modelwatch.sources.files import table

POSITIVE, NEGATIVE = "positive", "negative"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SHIFT_DAY = 20


def with_k(raw: DataFrame) -> DataFrame:
    """Replace the JSON text by its one number.

    As a generated row, so that a filter using k is not pushed below it and parses again.
    """
    k = F.expr("inline(array(struct(CAST(get_json_object(props, '$.k') AS INT) AS k)))")
    return raw.select(*[c for c in raw.columns if c != "props"], k)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_k(table(spark, sf_dir, "events"))


def as_predictions(ev: DataFrame) -> DataFrame:
    probability = F.col("value") / (F.col("value") + F.lit(50.0))
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("event_time"),
        "value",
        "k",
        "event_type",
        probability.alias("probability"),
        F.lit(0.5).alias("threshold"),
        decide(probability, F.lit(0.5), POSITIVE, NEGATIVE).alias("prediction"),
        F.lit("1").alias("model_version"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_predictions(events(spark, sf_dir))


def as_outcome_labels(ev: DataFrame) -> DataFrame:
    positive = F.col("k") < 30
    delay = F.when(positive, 1 + F.col("event_id") % 90).otherwise(90)
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.when(positive, 1).otherwise(0).alias("label"),
        plus_days("ts", delay).alias("available_at"),
    )


def outcome_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_outcome_labels(events(spark, sf_dir))


def as_request_log(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.lit("POST").alias("method"),
        F.when(F.col("event_type").isin("click", "view", "error"), "/predict")
        .otherwise("/healthz")
        .alias("path"),
        F.when(F.col("event_type") == "error", 500).when(F.col("k") < 5, 422).otherwise(200).alias("status_code"),
        F.col("value").alias("duration_ms"),
        (F.col("value") * 0.125).alias("routing_ms"),
        (F.col("value") * 0.5).alias("predict_ms"),
        F.when(F.col("k") % 10 != 0, F.col("value") * 0.25).alias("insert_ms"),
        F.col("ts").alias("created_at"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_request_log(events(spark, sf_dir))


def drift_reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events, unshifted."""
    return predictions(spark, sf_dir).filter(F.col("request_id") % 2 == 0)


def drift_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events; from day 20 on a growing share of them has its value doubled."""
    day = F.to_date("event_time")
    index = F.datediff(day, F.lit("2024-01-01").cast("date"))
    shifted = (index >= SHIFT_DAY) & (F.col("request_id") % 100 < 10 * (index - (SHIFT_DAY - 1)))
    return (
        predictions(spark, sf_dir)
        .filter(F.col("request_id") % 2 == 1)
        .select(
            day.alias("day"),
            F.when(shifted, F.col("value") * 2).otherwise(F.col("value")).alias("value"),
            "k",
            "event_type",
            shifted.alias("shifted"),
            "event_time",
        )
    )


def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderdate").alias("event_time"),
        F.when(high, POSITIVE).otherwise(NEGATIVE).alias("prediction"),
    )


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("request_id")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"),
        F.max("l_shipdate").alias("available_at"),
    )


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, y) for labelled documents."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("score")
    )
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return docs.join(truth, "doc_id")


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, score, y): every event with its outcome; scores repeat."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("score"),
        F.when(F.col("k") < 30, 1).otherwise(0).alias("y"),
    )
