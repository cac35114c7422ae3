"""Split and profiling queries over customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.operators import profile as op
from modelwatch.operators.features import standardise
from modelwatch.operators.splits import DEFAULT_STEPS, split_summary, stratified_split
from modelwatch.sources.derived import events
from modelwatch.sources.files import table
from modelwatch.suite.common import EVENTS, rounded

EXCLUDED = 9000
EDGES = [0, 25, 50, 75, 99]
LABELS = ["lowest", "lower", "upper", "highest"]


def manifest(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return stratified_split(
        customers, "c_custkey", "c_mktsegment", excluded=F.col("c_acctbal") >= EXCLUDED
    )


def _counts(spark, sf_dir):
    segments = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return manifest(spark, sf_dir).join(segments, "c_custkey").groupBy("split", "c_mktsegment").agg(
        F.count("*").alias("n")
    )


QUERIES = {
    "stratified_split": manifest,
    "stratified_split_counts": _counts,
    "split_summary": lambda s, d: rounded(
        split_summary(manifest(s, d), table(s, d, "customer"), "c_custkey", F.col("c_mktsegment") == "BUILDING")
    ),
    "segment_profile": lambda s, d: rounded(
        op.segment_profile(
            table(s, d, "customer"), F.col("c_mktsegment"), "c_mktsegment", F.col("c_acctbal") < 0
        )
    ),
    "excluded_segment_profile": lambda s, d: rounded(
        op.segment_profile(events(s, d), F.col("value") >= 100, "excluded", F.col("k") < 30)
    ),
    "banded_profile": lambda s, d: rounded(
        op.banded_profile(events(s, d), "k", EDGES, LABELS, F.col("event_type") == "purchase", "k_band")
    ),
    "grouped_describe": lambda s, d: rounded(
        op.grouped_describe(events(s, d), "event_type", ["value", "k"])
    ),
    "grouped_counts": lambda s, d: op.grouped_non_null_counts(
        events(s, d).select("event_type", "event_id", "ts", "value", "k"), "event_type"
    ),
    "overall_rate": lambda s, d: rounded(op.rate_of(events(s, d), F.col("event_type") == "purchase")),
    "standardise": lambda s, d: rounded(
        standardise(events(s, d).select("event_id", "value", "k"), ["value", "k"])
    ),
}


def _allot(step: str, name: str, fraction: float, source: str) -> str:
    """Quota of one step per class: ceil of the fraction, then largest remainders."""
    return f"""{step}_x AS (
        SELECT cls, left_n, ceil({fraction!r} * CAST(sum(left_n) OVER () AS DOUBLE)) AS total,
               (ceil({fraction!r} * CAST(sum(left_n) OVER () AS DOUBLE)) * left_n)
                   / CAST(sum(left_n) OVER () AS DOUBLE) AS exact
        FROM {source}),
    {step}_r AS (
        SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, cls) AS rnk,
               sum(floor(exact)) OVER () AS floors FROM {step}_x),
    {step} AS (
        SELECT cls, '{name}' AS split,
               CAST(floor(exact) + CASE WHEN rnk <= total - floors THEN 1 ELSE 0 END AS BIGINT) AS take,
               left_n - CAST(floor(exact) + CASE WHEN rnk <= total - floors THEN 1 ELSE 0 END AS BIGINT) AS left_n
        FROM {step}_r)"""


(_S1, _F1), (_S2, _F2), (_S3, _F3) = DEFAULT_STEPS
_MANIFEST = f"""WITH population AS (
        SELECT c_custkey, c_mktsegment AS cls,
               row_number() OVER (PARTITION BY c_mktsegment
                   ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS rn
        FROM customer WHERE c_acctbal < {EXCLUDED}),
    sizes AS (SELECT cls, count(*) AS left_n FROM population GROUP BY cls),
    {_allot('a', _S1, _F1, 'sizes')},
    {_allot('b', _S2, _F2, 'a')},
    {_allot('c', _S3, _F3, 'b')},
    ends AS (
        SELECT a.cls, a.take AS e1, a.take + b.take AS e2, a.take + b.take + c.take AS e3
        FROM a JOIN b USING (cls) JOIN c USING (cls)),
    manifest AS (
        SELECT c_custkey, CASE WHEN rn <= e1 THEN '{_S1}' WHEN rn <= e2 THEN '{_S2}'
                               WHEN rn <= e3 THEN '{_S3}' ELSE 'train' END AS split
        FROM population JOIN ends USING (cls)
        UNION ALL SELECT c_custkey, 'excluded' FROM customer WHERE c_acctbal >= {EXCLUDED})"""


def _profile(source: str, segment: str, name: str, positive: str, where: str = "TRUE") -> str:
    return f"""g AS (
        SELECT {segment} AS {name}, count(*) AS n, count(*) FILTER (WHERE {positive}) AS n_pos
        FROM {source} GROUP BY 1),
    p AS (
        SELECT {name}, n, round(100.0 * n / CAST(sum(n) OVER () AS DOUBLE), 6) AS pct_of_total,
               round(100.0 * n_pos / CAST(sum(n_pos) OVER () AS DOUBLE), 6) AS pct_of_positives,
               round(100.0 * n_pos / CAST(n AS DOUBLE), 6) AS positive_pct FROM g)
    SELECT * FROM p WHERE {where}"""


_BAND = """CASE WHEN k < 0 THEN NULL WHEN k <= 25 THEN 'lowest' WHEN k <= 50 THEN 'lower'
                WHEN k <= 75 THEN 'upper' WHEN k <= 99 THEN 'highest' END"""


def _describe(column: str) -> str:
    return f"""SELECT event_type, '{column}' AS column_name, count({column}) AS n, round(avg({column}), 6) AS mean,
               round(stddev_samp({column}), 6) AS std, round(CAST(min({column}) AS DOUBLE), 6) AS min,
               round(CAST(max({column}) AS DOUBLE), 6) AS max,
               round(quantile_cont(CAST({column} AS DOUBLE), 0.25), 6) AS q25,
               round(quantile_cont(CAST({column} AS DOUBLE), 0.5), 6) AS q50,
               round(quantile_cont(CAST({column} AS DOUBLE), 0.75), 6) AS q75
        FROM ev GROUP BY event_type"""


ORACLES = {
    "stratified_split": f"{_MANIFEST} SELECT c_custkey, split FROM manifest",
    "stratified_split_counts": f"""{_MANIFEST}
        SELECT split, c_mktsegment, count(*) AS n FROM manifest JOIN customer USING (c_custkey) GROUP BY 1, 2""",
    "split_summary": f"""{_MANIFEST}
        SELECT split, count(*) AS n,
               round(100.0 * avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END), 6) AS positive_pct
        FROM manifest JOIN customer USING (c_custkey) GROUP BY 1""",
    "segment_profile": "WITH " + _profile("customer", "c_mktsegment", "c_mktsegment", "c_acctbal < 0"),
    "excluded_segment_profile": f"WITH {EVENTS}, " + _profile("ev", "value >= 100", "excluded", "k < 30"),
    "banded_profile": f"WITH {EVENTS}, "
    + _profile("ev", _BAND, "k_band", "event_type = 'purchase'", "k_band IS NOT NULL"),
    "grouped_describe": f"WITH {EVENTS} {_describe('value')} UNION ALL {_describe('k')}",
    "grouped_counts": f"""WITH {EVENTS}
        SELECT event_type, count(event_id) AS event_id, count(ts) AS ts, count(value) AS value, count(k) AS k
        FROM ev GROUP BY 1""",
    "overall_rate": f"""WITH {EVENTS}
        SELECT round(100.0 * avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS rate_pct
        FROM ev""",
    "standardise": f"""WITH {EVENTS},
        m AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM ev)
        SELECT event_id, round(value, 6) AS value, k, round((value - mv) / sv, 6) AS value_scaled,
               round((k - mk) / sk, 6) AS k_scaled
        FROM ev CROSS JOIN m""",
}
