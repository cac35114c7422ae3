"""Contract, key and parity checks; validated joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.functions.columns import map_values
from modelwatch.operators import checks
from modelwatch.operators.contract import Contract, CrossRule, FieldRule, parse_records, validate, violations
from modelwatch.operators.joins import attach_truth, join_one_to_one, row_parity
from modelwatch.sources.derived import (
    events,
    order_labels,
    order_predictions,
    outcome_labels,
    predictions,
    request_log,
)
from modelwatch.sources.files import table
from modelwatch.suite.common import EVENTS, ORDER_FACTS, OUTCOME_LABELS, PREDICTIONS, REQUEST_LOG

EVENT_CONTRACT = Contract(
    fields=(
        FieldRule("event_type", "string", domain=("click", "error", "purchase", "view")),
        FieldRule("value", "float", minimum=1.0),
        FieldRule("k", "int", minimum=0),
        FieldRule("insert_ms", "float", minimum=0, nullable=True),
        FieldRule("event_time", "time", nullable=True, optional=True),
    ),
    cross=(CrossRule("insert_ms", "insert_ms IS NULL AND k <> 0"),),
)

PROPS_CONTRACT = Contract(
    fields=(FieldRule("k", "int", minimum=10), FieldRule("note", "string", optional=True)),
)

NOW = "2024-01-29 00:00:00"


def _checked(spark, sf_dir):
    ev = events(spark, sf_dir).select(
        "event_id",
        "event_type",
        "value",
        "k",
        F.when(F.col("k") % 10 != 0, F.col("value") * 0.25).alias("insert_ms"),
        F.col("ts").alias("event_time"),
    )
    return validate(ev, EVENT_CONTRACT, now=F.lit(NOW).cast("timestamp_ntz"))


def _errors(spark, sf_dir):
    return _checked(spark, sf_dir).filter(F.size("errors") > 0).select(
        "event_id", F.array_join("errors", ",").alias("errors")
    )


def _json_errors(spark, sf_dir):
    parsed = parse_records(table(spark, sf_dir, "events"), "props", PROPS_CONTRACT, keep=["event_id"])
    return validate(parsed, PROPS_CONTRACT).select(
        "event_id", "k", F.array_join("errors", ",").alias("errors")
    )


def _truth(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("customer_id")
    )
    segments = {"AUTOMOBILE": 1, "BUILDING": 1, "FURNITURE": 0, "HOUSEHOLD": 0, "MACHINERY": 0}
    truth = table(spark, sf_dir, "customer").select(
        "c_custkey", map_values("c_mktsegment", segments).alias("in_target")
    )
    return attach_truth(facts, truth, "c_custkey", "customer_id", "in_target").select(
        "request_id", "customer_id", "label"
    )


def _parity(spark, sf_dir):
    scored = predictions(spark, sf_dir).select("request_id", "probability")
    kept = scored.withColumn("probability", F.round("probability", 8))
    return row_parity(scored, kept, "request_id", {"probability": "probability"}, 2e-9).select("request_id")


QUERIES = {
    "model_version_guard": lambda s, d: checks.single_version_report(predictions(s, d), "1"),
    "model_versions": lambda s, d: checks.versions(predictions(s, d)),
    "unique_key_violations": lambda s, d: checks.duplicate_keys(
        table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    ),
    "fk_violations": lambda s, d: checks.orphans(
        order_predictions(s, d), order_labels(s, d), "request_id"
    ),
    "domain_violations": lambda s, d: checks.outside_domain(
        events(s, d), "event_type", ["click", "purchase", "view"]
    ).select("event_id", "event_type"),
    "null_counts": lambda s, d: checks.null_counts(
        request_log(s, d), ["duration_ms", "routing_ms", "predict_ms", "insert_ms"]
    ),
    "row_count_equality": lambda s, d: checks.row_count_difference(
        order_predictions(s, d), order_labels(s, d)
    ),
    "contract_violations": _errors,
    "contract_summary": lambda s, d: violations(_checked(s, d)),
    "contract_json": _json_errors,
    "join_one_to_one": lambda s, d: join_one_to_one(
        predictions(s, d).select("request_id", "prediction"), outcome_labels(s, d), "request_id"
    ),
    "join_truth_left": _truth,
    "row_parity": _parity,
}

_BROKEN = f"""WITH {EVENTS},
    checked AS (
        SELECT event_id, event_type NOT IN ('click', 'error', 'purchase', 'view') AS bad_type,
               value < 1.0 AS bad_value, k < 0 AS bad_k, k % 10 = 0 AND k <> 0 AS bad_insert,
               ts > TIMESTAMP '{NOW}' + INTERVAL 10 MINUTE AS bad_time
        FROM ev)"""

ORACLES = {
    "model_version_guard": f"""WITH {PREDICTIONS}
        SELECT count(DISTINCT model_version) AS n_versions, min(model_version) AS found_version,
               count(DISTINCT model_version) = 1 AND min(model_version) = '1' AS passes FROM predictions""",
    "model_versions": f"""WITH {PREDICTIONS}
        SELECT model_version, count(*) AS n_rows FROM predictions GROUP BY 1""",
    "unique_key_violations": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows
        FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "fk_violations": f"""WITH {ORDER_FACTS}
        SELECT * FROM order_predictions p
        WHERE NOT EXISTS (SELECT 1 FROM order_labels l WHERE l.request_id = p.request_id)""",
    "domain_violations": """SELECT event_id, event_type FROM events
        WHERE event_type NOT IN ('click', 'purchase', 'view')""",
    "null_counts": f"""WITH {REQUEST_LOG}
        SELECT 'duration_ms' AS column_name, count(*) FILTER (WHERE duration_ms IS NULL) AS n_missing FROM request_log
        UNION ALL SELECT 'routing_ms', count(*) FILTER (WHERE routing_ms IS NULL) FROM request_log
        UNION ALL SELECT 'predict_ms', count(*) FILTER (WHERE predict_ms IS NULL) FROM request_log
        UNION ALL SELECT 'insert_ms', count(*) FILTER (WHERE insert_ms IS NULL) FROM request_log""",
    "row_count_equality": f"""WITH {ORDER_FACTS}
        SELECT a.n AS n_left, b.n AS n_right, a.n = b.n AS equal
        FROM (SELECT count(*) AS n FROM order_predictions) a, (SELECT count(*) AS n FROM order_labels) b""",
    "contract_violations": f"""{_BROKEN}
        SELECT event_id, concat_ws(',', CASE WHEN bad_type THEN 'event_type' END,
               CASE WHEN bad_value THEN 'value' END, CASE WHEN bad_k THEN 'k' END,
               CASE WHEN bad_time THEN 'event_time' END, CASE WHEN bad_insert THEN 'insert_ms' END) AS errors
        FROM checked WHERE bad_type OR bad_value OR bad_k OR bad_insert OR bad_time""",
    "contract_summary": f"""{_BROKEN}, named AS (
            SELECT 'event_type' AS field FROM checked WHERE bad_type
            UNION ALL SELECT 'value' FROM checked WHERE bad_value
            UNION ALL SELECT 'k' FROM checked WHERE bad_k
            UNION ALL SELECT 'event_time' FROM checked WHERE bad_time
            UNION ALL SELECT 'insert_ms' FROM checked WHERE bad_insert)
        SELECT field, count(*) AS n_records FROM named GROUP BY 1""",
    "contract_json": f"""WITH {EVENTS}
        SELECT event_id, k, CASE WHEN k < 10 THEN 'k' ELSE '' END AS errors FROM ev""",
    "join_one_to_one": f"""WITH {PREDICTIONS}, {OUTCOME_LABELS}
        SELECT request_id, prediction, label, available_at
        FROM predictions JOIN outcome_labels USING (request_id)""",
    "join_truth_left": """SELECT o_orderkey AS request_id, o_custkey AS customer_id,
               CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 1 ELSE 0 END AS label
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "row_parity": f"""WITH {PREDICTIONS}
        SELECT request_id FROM predictions WHERE abs(probability - round(probability, 8)) > 2e-9""",
}
