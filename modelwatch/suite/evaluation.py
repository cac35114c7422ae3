"""Ranking-quality queries over labelled documents and over events with outcomes."""

from __future__ import annotations

from modelwatch.operators import evaluation as op
from modelwatch.sources.derived import scored_documents, scored_events
from modelwatch.suite.common import SCORED_DOCUMENTS, SCORED_EVENTS, rounded

FLOORS = (0.85, 0.87, 0.9)

QUERIES = {
    "average_precision": lambda s, d: rounded(op.evaluate(scored_documents(s, d))),
    "average_precision_events": lambda s, d: rounded(op.evaluate(scored_events(s, d))),
    "pr_curve": lambda s, d: rounded(op.pr_curve(scored_documents(s, d)), 9),
    "pr_curve_events": lambda s, d: rounded(op.pr_curve(scored_events(s, d)), 9),
    "operating_threshold": lambda s, d: rounded(
        op.operating_points(op.pr_curve(scored_documents(s, d)), FLOORS)
    ),
    "precision_recall_at": lambda s, d: rounded(op.precision_recall_at(scored_events(s, d), 0.5)),
    "gate_result": lambda s, d: rounded(op.gate(op.evaluate(scored_documents(s, d)))),
    "floor_cost": lambda s, d: rounded(op.floor_cost(scored_documents(s, d), 0.87, 0.85)),
    "bootstrap_band": lambda s, d: op.bootstrap_band(scored_documents(s, d)),
}

_CURVE = """ties AS (SELECT score, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM scored GROUP BY score),
    curve AS (
        SELECT score, n, pos, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos,
               sum(pos) OVER () AS positives
        FROM ties WINDOW w AS (ORDER BY score DESC)),
    pr AS (
        SELECT score AS threshold, cum_n AS n_flagged, cum_pos AS n_hits,
               cum_pos / CAST(cum_n AS DOUBLE) AS precision, cum_pos / CAST(positives AS DOUBLE) AS recall
        FROM curve)"""
_EVALUATE = """SELECT sum(pos * (cum_pos / CAST(cum_n AS DOUBLE))) / sum(pos) AS pr_auc,
               sum(pos) / CAST(sum(n) AS DOUBLE) AS prevalence, CAST(sum(n) AS BIGINT) AS n_sample FROM curve"""
_ROUND_EVALUATE = (
    f"SELECT round(pr_auc, 6) AS pr_auc, round(prevalence, 6) AS prevalence, n_sample FROM ({_EVALUATE})"
)
_ROUND_CURVE = """SELECT round(threshold, 9) AS threshold, n_flagged, n_hits, round(precision, 9) AS precision,
               round(recall, 9) AS recall FROM pr"""


def _lowest(floor: float) -> str:
    return f"(SELECT min(threshold) FROM pr WHERE precision >= {floor})"


ORACLES = {
    "average_precision": f"WITH {SCORED_DOCUMENTS}, {_CURVE} {_ROUND_EVALUATE}",
    "average_precision_events": f"WITH {SCORED_EVENTS}, {_CURVE} {_ROUND_EVALUATE}",
    "pr_curve": f"WITH {SCORED_DOCUMENTS}, {_CURVE} {_ROUND_CURVE}",
    "pr_curve_events": f"WITH {SCORED_EVENTS}, {_CURVE} {_ROUND_CURVE}",
    "operating_threshold": f"WITH {SCORED_DOCUMENTS}, {_CURVE} "
    + " UNION ALL ".join(
        f"""SELECT CAST({f} AS DOUBLE) AS min_precision, round(precision, 6) AS precision,
               round(recall, 6) AS recall, round(threshold, 6) AS threshold, n_flagged, n_hits
        FROM pr WHERE threshold = {_lowest(f)}"""
        for f in FLOORS
    ),
    "precision_recall_at": f"""WITH {SCORED_EVENTS},
        c AS (SELECT count(*) FILTER (WHERE score >= 0.5) AS n_flagged,
                     count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS n_hits,
                     count(*) FILTER (WHERE y = 1) AS n_pos FROM scored)
        SELECT n_flagged, n_hits, round(n_hits / CAST(n_flagged AS DOUBLE), 6) AS precision,
               round(n_hits / CAST(n_pos AS DOUBLE), 6) AS recall FROM c""",
    "gate_result": f"""WITH {SCORED_DOCUMENTS}, {_CURVE}
        SELECT 'pr_auc' AS metric, round(pr_auc, 6) AS value, CAST(0.64 AS DOUBLE) AS minimum,
               round(pr_auc - 0.64, 6) AS margin, pr_auc >= 0.64 AS passed FROM ({_EVALUATE})""",
    "floor_cost": f"""WITH {SCORED_DOCUMENTS}, {_CURVE},
        hi AS (SELECT * FROM pr WHERE threshold = {_lowest(0.87)}),
        lo AS (SELECT * FROM pr WHERE threshold = {_lowest(0.85)}),
        n AS (SELECT count(*) AS n FROM scored)
        SELECT round(hi.n_flagged / CAST(n.n AS DOUBLE), 6) AS share_flagged_high,
               round(lo.n_flagged / CAST(n.n AS DOUBLE), 6) AS share_flagged_low,
               lo.n_flagged - hi.n_flagged AS extra_flagged,
               round((lo.n_hits - hi.n_hits) / CAST(nullif(lo.n_flagged - hi.n_flagged, 0) AS DOUBLE), 6)
                   AS extra_precision
        FROM n, (SELECT max(n_flagged) AS n_flagged, max(n_hits) AS n_hits FROM hi) hi,
             (SELECT max(n_flagged) AS n_flagged, max(n_hits) AS n_hits FROM lo) lo""",
}
