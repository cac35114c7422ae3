"""Drift queries over the shifted fixture: even events are the reference, odd ones the traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators import alerts, drift
from modelwatch.plans.incremental import stored_counts, update_counts
from modelwatch.session import materialise, shared_path
from modelwatch.sources.derived import EVENT_TYPES, drift_reference_rows, drift_traffic
from modelwatch.suite.common import PREDICTIONS, rounded

NUMERIC = ["value", "k"]
CATEGORICAL = {"event_type": EVENT_TYPES}


def reference(spark: SparkSession, sf_dir: str) -> drift.DriftReference:
    return drift.fit_reference(drift_reference_rows(spark, sf_dir), NUMERIC, CATEGORICAL)


def metrics(spark: SparkSession, sf_dir: str, windows=drift.WINDOWS) -> DataFrame:
    return drift.drift_metrics(drift_traffic(spark, sf_dir), reference(spark, sf_dir), windows)


def stored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics as the small table they are kept as; the alert queries read it repeatedly."""
    return materialise(metrics(spark, sf_dir))


def _fit_bins(spark, sf_dir):
    edges = drift.fit_bin_edges(drift_reference_rows(spark, sf_dir), NUMERIC)
    return edges.select("feature", F.posexplode("edges").alias("edge_no", "edge")).withColumn(
        "edge", F.round("edge", 6)
    )


def _numeric_shares(spark, sf_dir):
    fitted = reference(spark, sf_dir)
    return rounded(drift.numeric_shares(drift_traffic(spark, sf_dir), fitted.numeric))


def _categorical_shares(spark, sf_dir):
    return rounded(
        drift.categorical_shares(
            drift_traffic(spark, sf_dir), {"event_type": ["click", "purchase", "refund", "view"]}
        )
    )


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = alerts.daily_share(drift_traffic(spark, sf_dir), "event_time", F.col("shifted"))
    return alerts.detections(stored_metrics(spark, sf_dir), daily_mix=mix, places=6)


def _chi_square(spark, sf_dir):
    stored = stored_metrics(spark, sf_dir)
    fitted = reference(spark, sf_dir)
    scored = [r for r in fitted.rows() if r[6]]
    counts = [(f, sum(r[1] == f for r in scored)) for f in fitted.features]
    bins = spark.createDataFrame(counts, "feature string, n_bins int")
    return rounded(alerts.chi_square_floor(stored, bins).select("day", "feature", "window_days", "noise_floor"))


def _agreement(spark, sf_dir):
    return alerts.agreement(alerts.detections(stored_metrics(spark, sf_dir)))


def _psi_between(spark, sf_dir):
    return rounded(drift.psi_between(drift_traffic(spark, sf_dir), reference(spark, sf_dir)))


def _incremental(spark, sf_dir):
    """Three appends, the last one back-dated, each followed by a run that counts its new files."""
    path, fitted = shared_path(spark, "incremental"), reference(spark, sf_dir)
    traffic = drift_traffic(spark, sf_dir).select("day", *fitted.features)
    late = F.coalesce(F.col("k") % 5 == 0, F.lit(True))
    early = F.datediff("day", F.lit("2024-01-01").cast("date")) < 15
    for part in (~late & early, ~late & ~early, late):
        traffic.filter(part).write.mode("append").partitionBy("day").parquet(f"{path}/facts")
        update_counts(spark, f"{path}/facts", f"{path}/counts", fitted, lambda rows: rows)
    return rounded(drift.rolling_psi(stored_counts(spark, f"{path}/counts", fitted), fitted))


QUERIES = {
    "fit_bins": _fit_bins,
    "numeric_shares": _numeric_shares,
    "categorical_shares": _categorical_shares,
    "drift_psi_1d": lambda s, d: rounded(metrics(s, d, (1,))),
    "drift_psi_7d": lambda s, d: rounded(metrics(s, d, (7,))),
    "drift_psi_whole": _psi_between,
    "drift_incremental": _incremental,
    "drift_noise_floor": lambda s, d: alerts.noise_floor(stored_metrics(s, d), places=6),
    "drift_alert_line": lambda s, d: rounded(alerts.alert_lines(stored_metrics(s, d))),
    "drift_detection": detection,
    "drift_with_alert": lambda s, d: rounded(alerts.metrics_with_line(stored_metrics(s, d))),
    "drift_summary": lambda s, d: drift.drift_summary(stored_metrics(s, d)),
    "drift_agreement": _agreement,
    "drift_chi_square_floor": _chi_square,
}

_FRACTIONS = ", ".join(
    f"({i}, CAST({q!r} AS DOUBLE))" for i, q in enumerate(drift.quantile_fractions())
)
_LEVELS = "[" + ", ".join(f"'{t}'" for t in EVENT_TYPES) + "]"

_BINNED = f"""WITH {PREDICTIONS},
ref AS (SELECT value, CAST(k AS DOUBLE) AS k, event_type FROM predictions WHERE request_id % 2 = 0),
dated AS (
    SELECT CAST(event_time AS DATE) AS day, value, k, event_type,
           CAST(event_time AS DATE) - DATE '2024-01-01' AS day_index, request_id
    FROM predictions WHERE request_id % 2 = 1),
traffic AS (
    SELECT day, day_index >= 20 AND request_id % 100 < 10 * (day_index - 19) AS shifted,
           CASE WHEN day_index >= 20 AND request_id % 100 < 10 * (day_index - 19)
                THEN value * 2 ELSE value END AS value,
           CAST(k AS DOUBLE) AS k, event_type
    FROM dated),
long_ref AS (SELECT 'value' AS feature, value AS x FROM ref UNION ALL SELECT 'k', k FROM ref),
ranked AS (
    SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS rn,
           count(*) OVER (PARTITION BY feature) AS n FROM long_ref),
fractions(i, q) AS (VALUES {_FRACTIONS}),
positions AS (
    SELECT DISTINCT feature, i, n, CAST(n - 1 AS DOUBLE) * q AS h FROM ranked CROSS JOIN fractions),
raw_edges AS (
    SELECT p.feature, p.i, p.h - floor(p.h) AS t, a.x AS lo, b.x AS hi
    FROM positions p
    JOIN ranked a ON a.feature = p.feature AND a.rn = CAST(floor(p.h) AS BIGINT) + 1
    JOIN ranked b ON b.feature = p.feature AND b.rn = least(CAST(floor(p.h) AS BIGINT) + 2, p.n)),
edges AS (
    SELECT DISTINCT feature,
           CASE WHEN t < 0.5 THEN lo + (hi - lo) * t ELSE hi - (hi - lo) * (1.0 - t) END AS edge
    FROM raw_edges),
inner_edges AS (
    SELECT feature, list(edge ORDER BY edge)[2:-2] AS es FROM edges GROUP BY feature)"""

_METRICS = f"""{_BINNED},
binned AS (
    SELECT 'ref' AS side, NULL AS day, feature, len(list_filter(es, lambda e: e < x)) AS bin
    FROM long_ref JOIN inner_edges USING (feature)
    UNION ALL
    SELECT 'cur', day, 'value', len(list_filter(es, lambda e: e < value))
    FROM traffic, inner_edges WHERE feature = 'value'
    UNION ALL
    SELECT 'cur', day, 'k', len(list_filter(es, lambda e: e < k))
    FROM traffic, inner_edges WHERE feature = 'k'
    UNION ALL
    SELECT 'ref', NULL, 'event_type', list_position({_LEVELS}, event_type) - 1 FROM ref
    UNION ALL
    SELECT 'cur', day, 'event_type', list_position({_LEVELS}, event_type) - 1 FROM traffic),
spine AS (
    SELECT feature, unnest(range(0, len(es) + 1)) AS bin FROM inner_edges
    UNION ALL SELECT feature, -1 FROM inner_edges
    UNION ALL SELECT 'event_type', unnest(range(0, {len(EVENT_TYPES)}))),
ref_n AS (SELECT count(*) AS n_ref FROM ref),
ref_share AS (
    SELECT s.feature, s.bin, count(b.bin) / CAST(n_ref AS DOUBLE) AS p, n_ref
    FROM spine s CROSS JOIN ref_n
    LEFT JOIN binned b ON b.side = 'ref' AND b.feature = s.feature AND b.bin = s.bin
    GROUP BY s.feature, s.bin, n_ref),
ends AS (
    SELECT DISTINCT t.day, w.window_days FROM traffic t CROSS JOIN (VALUES (1), (7)) w(window_days)
    WHERE t.day >= (SELECT min(day) FROM traffic) + CAST(w.window_days - 1 AS INTEGER)),
daily AS (SELECT day, feature, bin, count(*) AS cnt FROM binned WHERE side = 'cur' GROUP BY ALL),
windowed AS (
    SELECT e.day, e.window_days, d.feature, d.bin, sum(d.cnt) AS cnt
    FROM ends e JOIN daily d ON d.day <= e.day AND d.day > e.day - CAST(e.window_days AS INTEGER)
    GROUP BY ALL),
sizes AS (SELECT day, window_days, feature, sum(cnt) AS n_cur FROM windowed GROUP BY ALL),
terms AS (
    SELECT z.day, z.window_days, z.feature, z.n_cur, greatest(r.p, 0.5 / r.n_ref) AS p,
           greatest(coalesce(w.cnt, 0) / CAST(z.n_cur AS DOUBLE), 0.5 / z.n_cur) AS q
    FROM sizes z JOIN ref_share r ON r.feature = z.feature
    LEFT JOIN windowed w ON w.day = z.day AND w.window_days = z.window_days
         AND w.feature = z.feature AND w.bin = r.bin),
drift_metrics AS (
    SELECT day, feature, CAST(window_days AS INTEGER) AS window_days, sum((q - p) * ln(q / p)) AS psi,
           CAST(max(n_cur) AS BIGINT) AS n_rows
    FROM terms GROUP BY day, feature, window_days)"""

_ALERTS = f"""{_METRICS},
aged AS (SELECT *, day - min(day) OVER () AS age FROM drift_metrics),
lines AS (
    SELECT feature, window_days, p[1] + 3 * (p[2] - p[1]) AS alert_at
    FROM (SELECT feature, window_days, quantile_disc(psi, [0.5, 0.95]) AS p
          FROM aged WHERE age < 20 GROUP BY ALL)),
crossings AS (
    SELECT feature, window_days, alert_at, min(day) AS alert_day, min(age) AS day_index,
           CAST(count_if(age < 20) AS BIGINT) AS false_alarms
    FROM aged JOIN lines USING (feature, window_days)
    WHERE psi >= alert_at GROUP BY ALL)"""

_ROUNDED = "SELECT day, feature, window_days, round(psi, 6) AS psi, n_rows FROM drift_metrics"

ORACLES = {
    "fit_bins": f"""{_BINNED}
        SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY edge) - 1 AS INTEGER) AS edge_no,
               round(edge, 6) AS edge FROM edges""",
    "numeric_shares": f"""{_BINNED},
        rows AS (SELECT value, k FROM traffic),
        binned AS (
            SELECT 'value' AS feature, len(list_filter(es, lambda e: e < value)) AS bin
            FROM rows, inner_edges WHERE feature = 'value'
            UNION ALL SELECT 'k', len(list_filter(es, lambda e: e < k))
            FROM rows, inner_edges WHERE feature = 'k'),
        spine AS (
            SELECT feature, unnest(range(0, len(es) + 1)) AS bin FROM inner_edges
            UNION ALL SELECT feature, -1 FROM inner_edges)
        SELECT s.feature, CAST(s.bin AS INTEGER) AS bin, count(b.bin) AS cnt,
               round(count(b.bin) / CAST((SELECT count(*) FROM rows) AS DOUBLE), 6) AS share
        FROM spine s LEFT JOIN binned b ON b.feature = s.feature AND b.bin = s.bin GROUP BY 1, 2""",
    "categorical_shares": f"""{_BINNED},
        domain(bin, lvl) AS (VALUES (0, 'click'), (1, 'purchase'), (2, 'refund'), (3, 'view'))
        SELECT 'event_type' AS feature, bin, count(t.event_type) AS cnt,
               round(count(t.event_type) / CAST((SELECT count(*) FROM traffic) AS DOUBLE), 6) AS share
        FROM domain LEFT JOIN traffic t ON t.event_type = lvl GROUP BY bin""",
    "drift_psi_1d": f"{_METRICS} {_ROUNDED} WHERE window_days = 1",
    "drift_psi_7d": f"{_METRICS} {_ROUNDED} WHERE window_days = 7",
    "drift_incremental": f"{_METRICS} {_ROUNDED}",
    "drift_psi_whole": f"""{_METRICS},
        whole AS (SELECT feature, bin, sum(cnt) AS cnt FROM daily GROUP BY ALL),
        n AS (SELECT count(*) AS n_cur FROM traffic),
        t AS (
            SELECT r.feature, n_cur, greatest(r.p, 0.5 / r.n_ref) AS p,
                   greatest(coalesce(w.cnt, 0) / CAST(n_cur AS DOUBLE), 0.5 / n_cur) AS q
            FROM ref_share r CROSS JOIN n LEFT JOIN whole w ON w.feature = r.feature AND w.bin = r.bin)
        SELECT feature, round(sum((q - p) * ln(q / p)), 6) AS psi, max(n_cur) AS n_rows FROM t GROUP BY 1""",
    "drift_noise_floor": f"""{_ALERTS},
        quiet AS (
            SELECT feature, window_days, quantile_disc(psi, [0.5, 0.95]) AS p, max(psi) AS top
            FROM aged WHERE age < 20 GROUP BY ALL),
        moved AS (
            SELECT feature, window_days, quantile_disc(psi, 0.5) AS p50, max(psi) AS top
            FROM aged WHERE age >= 20 GROUP BY ALL)
        SELECT feature, window_days, round(q.p[1], 6) AS baseline_p50, round(q.p[2], 6) AS baseline_p95,
               round(q.top, 6) AS baseline_max, round(alert_at, 6) AS alert_at, round(m.p50, 6) AS ramp_p50,
               round(m.top, 6) AS ramp_max, round(m.p50 / nullif(q.top, 0), 4) AS separation
        FROM quiet q JOIN moved m USING (feature, window_days) JOIN lines USING (feature, window_days)""",
    "drift_alert_line": f"{_ALERTS} SELECT feature, window_days, round(alert_at, 6) AS alert_at FROM lines",
    "drift_detection": f"""{_ALERTS},
        mix AS (SELECT day, avg(CASE WHEN shifted THEN 1.0 ELSE 0.0 END) AS shifted_share FROM traffic GROUP BY 1)
        SELECT feature, window_days, round(alert_at, 6) AS alert_at, false_alarms, alert_day, day_index,
               round(100 * shifted_share, 3) AS shifted_pct_that_day
        FROM crossings LEFT JOIN mix ON mix.day = alert_day""",
    "drift_with_alert": f"""{_ALERTS}
        SELECT day, feature, window_days, round(psi, 6) AS psi, n_rows, round(alert_at, 6) AS alert_at,
               coalesce(psi >= alert_at, FALSE) AS crossed
        FROM drift_metrics LEFT JOIN lines USING (feature, window_days)""",
    "drift_summary": f"""{_METRICS}
        SELECT window_days, count(*) AS n_metrics, count(DISTINCT day) AS n_days FROM drift_metrics GROUP BY 1""",
    "drift_agreement": f"""{_ALERTS},
        per_day AS (SELECT window_days, alert_day, count(*) AS n_new FROM crossings GROUP BY 1, 2)
        SELECT window_days, alert_day, n_new,
               CAST(sum(n_new) OVER (PARTITION BY window_days ORDER BY alert_day) AS BIGINT) AS n_crossed
        FROM per_day""",
    "drift_chi_square_floor": f"""{_METRICS}
        SELECT day, feature, window_days,
               round((coalesce(n_bins, (SELECT count(DISTINCT event_type) FROM ref)) - 1) / CAST(n_rows AS DOUBLE), 6)
                   AS noise_floor
        FROM drift_metrics LEFT JOIN (
            -- intervals between inner edges, two open ends, and the bin of missing values
            SELECT feature, len(es) + 2 AS n_bins FROM inner_edges) USING (feature)""",
}
