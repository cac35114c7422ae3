"""Latency profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.operators import latency as op
from modelwatch.schemas import LATENCY_BUCKETS
from modelwatch.sources.derived import request_log
from modelwatch.suite.common import REQUEST_LOG, rounded

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}

BOUND_ROWS = ", ".join(
    [f"({i}, '{op.bucket_label(b)}', CAST({b!r} AS DOUBLE))" for i, b in enumerate(LATENCY_BUCKETS)]
    + [f"({len(LATENCY_BUCKETS)}, '+Inf', CAST('Infinity' AS DOUBLE))"]
)
BOUNDS = f"bounds(le_ord, le, bound) AS (VALUES {BOUND_ROWS})"
QUANTILE_ROWS = ", ".join(f"('{k}', CAST({q!r} AS DOUBLE))" for k, q in QUANTILES.items())


def histogram_sql(source: str, seconds: str, by: str) -> str:
    return f"""hist AS (
    SELECT {by}, b.le_ord, b.le, b.bound, CAST(count(*) FILTER (WHERE {seconds} <= b.bound) AS BIGINT) AS cum
    FROM {source} CROSS JOIN bounds b GROUP BY {by}, b.le_ord, b.le, b.bound)"""


def quantile_sql(by: str) -> str:
    """Rows ({by}, q_name, estimate) from the CTE `hist`."""
    return f"""steps AS (
    SELECT {by}, le_ord, bound, cum, max(cum) OVER (PARTITION BY {by}) AS total,
           coalesce(lag(cum) OVER w, 0) AS prev_cum, coalesce(lag(bound) OVER w, 0.0) AS prev_bound
    FROM hist WINDOW w AS (PARTITION BY {by} ORDER BY le_ord)),
quants(q_name, q) AS (VALUES {QUANTILE_ROWS}),
hit AS (
    SELECT {by}, q_name, q, min(le_ord) AS le_ord
    FROM steps CROSS JOIN quants WHERE cum >= q * total GROUP BY {by}, q_name, q),
estimates AS (
    SELECT {", ".join("h." + c.strip() for c in by.split(","))}, h.q_name,
           CASE WHEN s.bound = CAST('Infinity' AS DOUBLE) THEN s.prev_bound
                ELSE s.prev_bound + (s.bound - s.prev_bound)
                     * ((h.q * s.total - s.prev_cum) / (s.cum - s.prev_cum)) END AS estimate
    FROM hit h JOIN steps s USING ({by}, le_ord))"""


PIVOTED = ", ".join(f"round(max(estimate) FILTER (WHERE q_name = '{k}'), 6) AS {k}" for k in QUANTILES)


def _merged(spark, sf_dir):
    instance = request_log(spark, sf_dir).withColumn("instance", F.col("request_id") % 4)
    return op.merge_histograms(op.latency_histogram(instance, ["path", "instance"]))


QUERIES = {
    "latency_total": lambda s, d: op.total_percentiles(request_log(s, d)),
    "latency_by_phase": lambda s, d: op.phase_percentiles(request_log(s, d)),
    "latency_composition": lambda s, d: op.composition(request_log(s, d), places=6),
    "latency_phases_long": lambda s, d: op.phases_long(request_log(s, d)),
    "latency_histogram": lambda s, d: op.latency_histogram(request_log(s, d)),
    "histogram_merge": _merged,
    "histogram_quantile": lambda s, d: rounded(
        op.histogram_quantile(op.latency_histogram(request_log(s, d)), QUANTILES)
    ),
    "quantile_error": lambda s, d: rounded(op.quantile_error(request_log(s, d))),
}

_OK = "path = '/predict' AND status_code = 200"
_TIMED = f"{_OK} AND routing_ms IS NOT NULL AND predict_ms IS NOT NULL AND insert_ms IS NOT NULL"


ORACLES = {
    "latency_total": f"""WITH {REQUEST_LOG},
        q AS (
            SELECT count(*) AS n, quantile_disc(duration_ms, [0.5, 0.95, 0.99]) AS p, max(duration_ms) AS max_ms
            FROM request_log WHERE {_OK})
        SELECT n, p[1] AS p50_ms, p[2] AS p95_ms, p[3] AS p99_ms, max_ms FROM q""",
    "latency_by_phase": f"""WITH {REQUEST_LOG},
        long AS (
            UNPIVOT (SELECT routing_ms AS routing, predict_ms AS predict, insert_ms AS insert, duration_ms AS total
                     FROM request_log WHERE {_TIMED})
            ON routing, predict, insert, total INTO NAME phase VALUE ms),
        q AS (SELECT phase, quantile_disc(ms, [0.5, 0.95, 0.99]) AS p FROM long GROUP BY phase)
        SELECT phase, p[1] AS p50_ms, p[2] AS p95_ms, p[3] AS p99_ms FROM q""",
    "latency_composition": f"""WITH {REQUEST_LOG},
        base AS (SELECT * FROM request_log WHERE {_TIMED}),
        cuts AS (SELECT quantile_disc(duration_ms, [0.45, 0.55, 0.99]) AS p FROM base),
        means AS (
            SELECT if(duration_ms >= p[1] AND duration_ms <= p[2], 'p50', 'p99+') AS bucket, count(*) AS n,
                   avg(duration_ms) AS t, avg(routing_ms) AS a, avg(predict_ms) AS b, avg(insert_ms) AS c,
                   avg(duration_ms - (routing_ms + predict_ms + insert_ms)) AS d
            FROM base, cuts
            WHERE (duration_ms >= p[1] AND duration_ms <= p[2]) OR duration_ms >= p[3]
            GROUP BY 1)
        SELECT bucket, n, round(t, 6) AS avg_total_ms, round(a, 6) AS routing_ms, round(b, 6) AS predict_ms,
               round(c, 6) AS insert_ms, round(d, 6) AS other_ms, round(100 * a / t, 5) AS routing_pct,
               round(100 * b / t, 5) AS predict_pct, round(100 * c / t, 5) AS insert_pct,
               round(100 * d / t, 5) AS other_pct
        FROM means""",
    "latency_phases_long": f"""WITH {REQUEST_LOG}
        SELECT request_id, 'routing' AS phase, routing_ms AS ms FROM request_log
        UNION ALL SELECT request_id, 'predict', predict_ms FROM request_log
        UNION ALL SELECT request_id, 'insert', insert_ms FROM request_log
        UNION ALL SELECT request_id, 'total', duration_ms FROM request_log""",
    "latency_histogram": f"""WITH {REQUEST_LOG}, {BOUNDS},
        {histogram_sql('request_log', 'duration_ms / 1000.0', 'path')}
        SELECT path, le_ord, le, cum FROM hist""",
    "histogram_merge": f"""WITH {REQUEST_LOG}, {BOUNDS},
        {histogram_sql('request_log', 'duration_ms / 1000.0', 'path')}
        SELECT path, le_ord, le, cum FROM hist""",
    "histogram_quantile": f"""WITH {REQUEST_LOG}, {BOUNDS},
        {histogram_sql('request_log', 'duration_ms / 1000.0', 'path')},
        {quantile_sql('path')}
        SELECT path, {PIVOTED} FROM estimates GROUP BY path""",
    "quantile_error": f"""WITH {REQUEST_LOG}, {BOUNDS},
        base AS (SELECT path, duration_ms / 1000.0 AS seconds FROM request_log WHERE {_OK}),
        {histogram_sql('base', 'seconds', 'path')},
        {quantile_sql('path')},
        exact AS (
            SELECT unnest(['p50', 'p95', 'p99']) AS q_name,
                   unnest(quantile_disc(seconds, [0.5, 0.95, 0.99])) AS x FROM base)
        SELECT q_name AS quantile, round(x, 6) AS exact, round(estimate, 6) AS estimated,
               round(estimate - x, 6) AS error, round(100 * (estimate - x) / x, 6) AS error_pct
        FROM exact JOIN estimates USING (q_name)""",
}
