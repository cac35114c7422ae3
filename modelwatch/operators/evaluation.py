"""Ranking quality: average precision, PR curve, operating threshold, bootstrap band, gate.

Scores are tie-grouped first, so a score shared by many rows is one row from then on, and
the running totals over descending score are computed range by range (see `ordering`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.columns import ratio
from modelwatch.operators.checks import CheckFailed
from modelwatch.operators.ordering import cut_blocks, running_totals, sketch_cuts

GATE_MIN_PR_AUC = 0.64
MIN_PRECISION = 0.60
#: Name and rows of a range of the bootstrap.
RANGE = "_range"
RANGE_ROWS = 65_536


def tie_groups(scored: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    """(score, n, pos): one row per distinct score."""
    return scored.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col(truth).cast("bigint")).alias("pos")
    )


def rank_scores(scored: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    """Tie groups in score ranges, highest first, read by every measure below.

    A sketch of the raw scores gives the cuts, as many ranges as there are shuffle partitions. Nothing is
    stored: what reads the result scans `scored` again, so `scored` must give the same rows each time.
    """
    pieces = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sketch_cuts(scored, score, pieces)
    return cut_blocks(tie_groups(scored, score, truth), "score", cuts, descending=True)


def _running(ranked: DataFrame) -> DataFrame:
    return running_totals(ranked, [], "score", ["n", "pos"], descending=True)


def curve_of(ranked: DataFrame) -> DataFrame:
    """(threshold, n_flagged, n_hits, precision, recall) for every distinct score."""
    total = ranked.agg(F.sum("pos").alias("_positives"))  # one row
    return _running(ranked).crossJoin(F.broadcast(total)).select(
        F.col("score").alias("threshold"),
        F.col("cum_n").alias("n_flagged"),
        F.col("cum_pos").alias("n_hits"),
        ratio("cum_pos", "cum_n").alias("precision"),
        ratio("cum_pos", "_positives").alias("recall"),
    )


def pr_curve(scored: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    return curve_of(rank_scores(scored, score, truth))


def summary_of(ranked: DataFrame) -> DataFrame:
    """One row (pr_auc, prevalence, n_sample); pr_auc is step-wise average precision.

    The recall gained at a threshold is its own positives over all positives, so the sum
    needs the running totals only for the precision. Without positives it is 0.
    """
    gained = F.sum(F.col("pos") * ratio("cum_pos", "cum_n"))
    return _running(ranked).agg(
        F.coalesce(ratio(gained, F.sum("pos")), F.lit(0.0)).alias("pr_auc"),
        ratio(F.sum("pos"), F.sum("n")).alias("prevalence"),
        F.sum("n").alias("n_sample"),
    )


def evaluate(scored: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    return summary_of(rank_scores(scored, score, truth))


def operating_points(curve: DataFrame, floors: Sequence[float]) -> DataFrame:
    """For each precision floor the lowest threshold that meets it; unmet floors are absent.

    One pass over the curve whatever the number of floors.
    """
    best = curve.agg(
        *[
            F.min_by(
                F.struct("threshold", "precision", "recall", "n_flagged", "n_hits"),
                F.when(F.col("precision") >= F.lit(float(f)), F.col("threshold")),
            ).alias(f"_p{i}")
            for i, f in enumerate(floors)
        ]
    )
    rows = F.array(
        *[F.struct(F.lit(float(f)).alias("min_precision"), F.col(f"_p{i}").alias("p")) for i, f in enumerate(floors)]
    )
    return (
        best.select(F.inline(rows))
        .filter(F.col("p").isNotNull())
        .select("min_precision", "p.precision", "p.recall", "p.threshold", "p.n_flagged", "p.n_hits")
    )


def threshold_of(ranked: DataFrame, min_precision: float = MIN_PRECISION) -> tuple[float, float, float]:
    """(precision, recall, threshold) at the lowest threshold meeting the floor; error if none."""
    row = operating_points(curve_of(ranked), [min_precision]).first()
    if row is None:
        raise ValueError(f"no threshold reaches min_precision={min_precision}")
    return row["precision"], row["recall"], row["threshold"]


def find_threshold(
    scored: DataFrame, min_precision: float = MIN_PRECISION, score: str = "score", truth: str = "y"
) -> tuple[float, float, float]:
    return threshold_of(rank_scores(scored, score, truth), min_precision)


def precision_recall_at(
    scored: DataFrame, threshold: float, score: str = "score", truth: str = "y"
) -> DataFrame:
    flagged = F.col(score) >= F.lit(float(threshold))
    hit = F.col(truth) == 1
    return scored.agg(
        F.count_if(flagged).alias("n_flagged"),
        F.count_if(flagged & hit).alias("n_hits"),
        F.count_if(hit).alias("n_positives"),
    ).select(
        "n_flagged",
        "n_hits",
        ratio("n_hits", "n_flagged").alias("precision"),
        ratio("n_hits", "n_positives").alias("recall"),
    )


def floor_cost(
    scored: DataFrame, high: float, low: float, score: str = "score", truth: str = "y"
) -> DataFrame:
    """What lowering the precision floor buys: share flagged and precision of the extra rows."""
    ranked = rank_scores(scored, score, truth)
    points = operating_points(curve_of(ranked), [high, low])
    n_rows = ranked.agg(F.sum("n").alias("_n"))  # one row
    wanted = [
        F.max(F.when(F.col("min_precision") == float(floor), F.col(c))).alias(f"_{name}_{c}")
        for name, floor in (("high", high), ("low", low))
        for c in ("n_flagged", "n_hits")
    ]
    return (
        points.agg(*wanted)
        .crossJoin(F.broadcast(n_rows))
        .select(
            ratio("_high_n_flagged", "_n").alias("share_flagged_high"),
            ratio("_low_n_flagged", "_n").alias("share_flagged_low"),
            (F.col("_low_n_flagged") - F.col("_high_n_flagged")).alias("extra_flagged"),
            ratio(
                F.col("_low_n_hits") - F.col("_high_n_hits"),
                F.col("_low_n_flagged") - F.col("_high_n_flagged"),
            ).alias("extra_precision"),
        )
    )


def gate(metrics: DataFrame, minimum: float = GATE_MIN_PR_AUC, metric: str = "pr_auc") -> DataFrame:
    """One row (metric, value, minimum, margin, passed)."""
    return metrics.select(
        F.lit(metric).alias("metric"),
        F.col(metric).alias("value"),
        F.lit(float(minimum)).alias("minimum"),
        (F.col(metric) - F.lit(float(minimum))).alias("margin"),
        (F.col(metric) >= F.lit(float(minimum))).alias("passed"),
    )


def require_gate(metrics: DataFrame, minimum: float = GATE_MIN_PR_AUC, metric: str = "pr_auc") -> float:
    row = gate(metrics, minimum, metric).first()
    if not row["passed"]:
        raise CheckFailed(f"{metric} {row['value']:.4f} is below {minimum:.4f} ({row['margin']:.4f})")
    return row["margin"]


def _paths(cells: DataFrame, levels: int) -> DataFrame:
    """The binary tree over range numbers, dealt to its leaves: `levels` rows for each range.

    Node p of level l covers the ranges r with r >> (l + 1) = p. A row of range r holds the positives and
    negatives under both children of one of the nodes above it: (RANGE, level, left_pos, left_neg, right_pos, right_neg).
    """
    rungs = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    rungs = rungs.withColumns(
        {
            "parent": F.expr(f"shiftright({RANGE}, level + 1)"),
            "on_right": F.expr(f"shiftright({RANGE}, level) & 1 = 1"),
        }
    )
    children = [
        F.coalesce(F.sum(F.when(F.col("on_right") == right, F.col(outcome))), F.lit(0)).alias(f"{side}_{outcome}")
        for side, right in (("left", False), ("right", True))
        for outcome in ("pos", "neg")
    ]
    nodes = rungs.groupBy("level", "parent").agg(*children)
    # A column of its own, since the cells are read again beside this.
    return rungs.join(nodes, ["level", "parent"]).select(F.col(RANGE).alias(RANGE), "level", *nodes.columns[2:])


def _draw_path(at: int, path: pd.DataFrame, n_iterations: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(drawn, above, positives) of range `at` for every iteration, from the splits on its path alone.

    drawn and above are (2, n_iterations): positives and negatives drawn inside the range and in the
    ranges before it. Each split is binomial and seeded by its node, so all ranges below repeat the same one.
    """
    path = path.sort_values("level", ascending=False)
    sums = {c: path[c].to_numpy(np.int64) for c in path.columns if c != RANGE}
    whole = [int(sums[f"left_{o}"][0] + sums[f"right_{o}"][0]) for o in ("pos", "neg")]
    n = sum(whole)
    hits = np.random.default_rng([seed, 0]).binomial(n, whole[0] / n, n_iterations)
    drawn, above = np.stack([hits, n - hits]), np.zeros((2, n_iterations), np.int64)
    for i, level in enumerate(sums["level"].tolist()):
        for side, outcome in enumerate(("pos", "neg")):
            left, right = int(sums[f"left_{outcome}"][i]), int(sums[f"right_{outcome}"][i])
            rng = np.random.default_rng([seed, 1, side, level, at >> (level + 1)])
            to_left = rng.binomial(drawn[side], left / max(left + right, 1))
            if at >> level & 1:
                above[side] += to_left
                drawn[side] = drawn[side] - to_left
            else:
                drawn[side] = to_left
    return drawn, above, hits


def bootstrap_average_precision(
    scored: DataFrame,
    n_iterations: int = 1000,
    seed: int = 42,
    score: str = "score",
    truth: str = "y",
) -> DataFrame:
    """(iteration, pr_auc) of resamples of n rows drawn with replacement.

    Drawing n rows is a multinomial draw over the cells (score, outcome), which splits exactly into
    binomial draws down a binary tree over score ranges, followed by a multinomial inside each range.
    A task repeats only the splits on its range's path, from seeds of their own, which tells it how many
    flagged rows and hits lie above its range. So work is ranges x log(ranges), nothing is collected, no
    drawn row is ever shuffled or joined, and what leaves a task is one partial sum per iteration.

    Ranges follow from the rows above a score, RANGE_ROWS each (a tie group is not split, but is one
    row), so the draws depend on data and seed alone, and a task's frame is bounded.
    """
    n = scored.count()
    if not n:
        raise ValueError("nothing to resample")
    levels = max(1, ((n - 1) // RANGE_ROWS).bit_length())
    blocks = _running(rank_scores(scored, score, truth)).select(
        "score", "n", "pos", F.expr(f"(cum_n - 1) div {RANGE_ROWS}").alias(RANGE)
    )
    cells = blocks.groupBy(RANGE).agg(F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))

    def one_range(pdf: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", ascending=False)
        drawn, above, positives = _draw_path(int(pdf[RANGE].iloc[0]), path, n_iterations, seed)
        pos = pdf["pos"].to_numpy(dtype=np.int64)
        neg = pdf["n"].to_numpy(dtype=np.int64) - pos
        p_pos, p_neg = pos / max(pos.sum(), 1), neg / max(neg.sum(), 1)
        rng = np.random.default_rng([seed, 2, int(pdf[RANGE].iloc[0])])
        partial = np.zeros(n_iterations)
        for i in range(n_iterations):
            # An outcome that the range has not was drawn 0 times.
            hits = rng.multinomial(drawn[0, i], p_pos) if drawn[0, i] else np.zeros_like(pos)
            misses = rng.multinomial(drawn[1, i], p_neg) if drawn[1, i] else np.zeros_like(neg)
            tp = above[0, i] + np.cumsum(hits)
            flagged = above[:, i].sum() + np.cumsum(hits + misses)
            got = hits > 0
            partial[i] = np.sum(hits[got] * tp[got] / flagged[got])
        return pd.DataFrame({"iteration": np.arange(n_iterations), "partial": partial, "positives": positives})

    return (
        blocks.groupBy(RANGE)
        .cogroup(_paths(cells, levels).groupBy(RANGE))
        .applyInPandas(one_range, "iteration int, partial double, positives bigint")
        .groupBy("iteration")
        .agg(
            F.coalesce(ratio(F.sum("partial"), F.max("positives")), F.lit(0.0)).alias("pr_auc")
        )
    )


def bootstrap_band(
    scored: DataFrame,
    n_iterations: int = 1000,
    seed: int = 42,
    score: str = "score",
    truth: str = "y",
) -> DataFrame:
    """One row (p2_5, p50, p97_5): linear percentiles of the resampled average precision."""
    runs = bootstrap_average_precision(scored, n_iterations, seed, score, truth)
    p = F.percentile("pr_auc", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return runs.agg(p.alias("_p")).select(
        F.col("_p")[0].alias("p2_5"), F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p97_5")
    )

