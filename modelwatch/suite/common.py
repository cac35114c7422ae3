"""SQL twins of the derived monitoring tables, and rounding of outputs.

Doubles are rounded in both engines: sums over rows depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = """ev AS (
    SELECT event_id, ts, user_id, event_type, value,
           CAST(json_extract(props, '$.k') AS INTEGER) AS k
    FROM events)"""

PREDICTIONS = f"""{EVENTS},
predictions AS (
    SELECT event_id AS request_id, user_id AS customer_id, ts AS event_time, value, k, event_type,
           value / (value + 50.0) AS probability, CAST(0.5 AS DOUBLE) AS threshold,
           CASE WHEN value / (value + 50.0) >= 0.5 THEN 'positive' ELSE 'negative' END AS prediction,
           '1' AS model_version
    FROM ev)"""

OUTCOME_LABELS = """outcome_labels AS (
    SELECT event_id AS request_id,
           CASE WHEN k < 30 THEN 1 ELSE 0 END AS label,
           ts + to_days(CAST(CASE WHEN k < 30 THEN 1 + event_id % 90 ELSE 90 END AS INTEGER)) AS available_at
    FROM ev)"""

REQUEST_LOG = f"""{EVENTS},
request_log AS (
    SELECT event_id AS request_id, 'POST' AS method,
           CASE WHEN event_type IN ('click', 'view', 'error') THEN '/predict' ELSE '/healthz' END AS path,
           CASE WHEN event_type = 'error' THEN 500 WHEN k < 5 THEN 422 ELSE 200 END AS status_code,
           value AS duration_ms, value * CAST(0.125 AS DOUBLE) AS routing_ms,
           value * CAST(0.5 AS DOUBLE) AS predict_ms,
           CASE WHEN k % 10 <> 0 THEN value * CAST(0.25 AS DOUBLE) END AS insert_ms,
           ts AS created_at
    FROM ev)"""

ORDER_FACTS = """order_predictions AS (
    SELECT o_orderkey AS request_id, o_orderdate AS event_time,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'positive' ELSE 'negative' END AS prediction
    FROM orders),
order_labels AS (
    SELECT l_orderkey AS request_id,
           max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label,
           max(l_shipdate) AS available_at
    FROM lineitem GROUP BY l_orderkey)"""

SCORED_DOCUMENTS = """scored AS (
    SELECT d.doc_id, d.n_chars / (d.n_chars + CAST(1000.0 AS DOUBLE)) AS score, l.quality AS y
    FROM documents d JOIN labels l USING (doc_id))"""

SCORED_EVENTS = f"""{EVENTS},
scored AS (
    SELECT event_id AS request_id, value / (value + CAST(50.0 AS DOUBLE)) AS score,
           CASE WHEN k < 30 THEN 1 ELSE 0 END AS y
    FROM ev)"""


def rounded(df: DataFrame, places: int = 6, **overrides: int) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[
            F.round(f.name, overrides.get(f.name, places)).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema
        ]
    )
