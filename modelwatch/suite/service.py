"""Dashboard queries: rates, errors, latency over time, daily model series."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwatch.operators import service as op
from modelwatch.operators.alerts import daily_share
from modelwatch.sources.derived import POSITIVE, predictions, request_log
from modelwatch.suite.common import PREDICTIONS, REQUEST_LOG, rounded
from modelwatch.suite.latency import BOUNDS, PIVOTED, QUANTILES, histogram_sql, quantile_sql

HOUR, SIX_HOURS = 3600, 21600

QUERIES = {
    "request_counts": lambda s, d: op.request_counts(request_log(s, d)),
    "request_rate": lambda s, d: rounded(op.request_rate(request_log(s, d), HOUR), 9),
    "error_ratio": lambda s, d: rounded(op.error_ratio(request_log(s, d), HOUR)),
    "latency_over_time": lambda s, d: rounded(
        op.latency_over_time(request_log(s, d), SIX_HOURS, QUANTILES)
    ),
    "predictions_daily": lambda s, d: rounded(op.predictions_daily(predictions(s, d), POSITIVE)),
    "score_quantiles_daily": lambda s, d: rounded(op.score_quantiles_daily(predictions(s, d)), 9),
    "segment_share_daily": lambda s, d: rounded(
        daily_share(predictions(s, d), "event_time", F.col("value") >= 100)
    ),
}


def _bucket(width: str, column: str = "created_at") -> str:
    return f"time_bucket(INTERVAL '{width}', {column}, TIMESTAMP '1970-01-01')"


ORACLES = {
    "request_counts": f"""WITH {REQUEST_LOG}
        SELECT method, path, status_code, count(*) AS n_requests FROM request_log GROUP BY ALL""",
    "request_rate": f"""WITH {REQUEST_LOG}
        SELECT {_bucket('1 hour')} AS bucket, path, round(count(*) / 3600.0, 9) AS per_second
        FROM request_log GROUP BY 1, 2""",
    "error_ratio": f"""WITH {REQUEST_LOG}
        SELECT {_bucket('1 hour')} AS bucket,
               round(count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) / CAST(count(*) AS DOUBLE), 6)
                   AS client_error_ratio,
               round(count(*) FILTER (WHERE status_code BETWEEN 500 AND 599) / CAST(count(*) AS DOUBLE), 6)
                   AS server_error_ratio
        FROM request_log GROUP BY 1""",
    "latency_over_time": f"""WITH {REQUEST_LOG}, {BOUNDS},
        base AS (SELECT {_bucket('6 hours')} AS bucket, duration_ms / 1000.0 AS seconds
                 FROM request_log WHERE path = '/predict'),
        {histogram_sql('base', 'seconds', 'bucket')},
        {quantile_sql('bucket')}
        SELECT bucket, {PIVOTED} FROM estimates GROUP BY bucket""",
    "predictions_daily": f"""WITH {PREDICTIONS}
        SELECT CAST(event_time AS DATE) AS day, count(*) AS n_predictions,
               round(avg(CASE WHEN prediction = 'positive' THEN 1.0 ELSE 0.0 END), 6) AS positive_share
        FROM predictions GROUP BY 1""",
    "score_quantiles_daily": f"""WITH {PREDICTIONS}
        SELECT CAST(event_time AS DATE) AS day, count(*) AS n,
               round(percentile_disc(0.1) WITHIN GROUP (ORDER BY probability), 9) AS p10,
               round(percentile_disc(0.5) WITHIN GROUP (ORDER BY probability), 9) AS p50,
               round(percentile_disc(0.9) WITHIN GROUP (ORDER BY probability), 9) AS p90
        FROM predictions GROUP BY 1""",
    "segment_share_daily": f"""WITH {PREDICTIONS}
        SELECT CAST(event_time AS DATE) AS day,
               round(avg(CASE WHEN value >= 100 THEN 1.0 ELSE 0.0 END), 6) AS shifted_share
        FROM predictions GROUP BY 1""",
}
