import numpy as np
import pandas as pd
import pytest

from modelwatch.operators import evaluation as ev
from modelwatch.operators.checks import CheckFailed

TIED = [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 1), (0.5, 0), (0.5, 1)]


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, y int")


def brute_ap(score, y):
    ap, positives = 0.0, y.sum()
    for t in np.unique(score):
        flagged = score >= t
        here = score == t
        ap += y[here].sum() / positives * y[flagged].sum() / flagged.sum()
    return ap


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    y = (rng.random(3000) < 0.3).astype(int)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 3)
    score[:1000] = 0.5  # a third of the rows share one score
    return score, y


def frame(spark, sample):
    return scored(spark, [(float(s), int(t)) for s, t in zip(*sample)]).repartition(6)


def test_average_precision_with_ties(spark):
    row = ev.evaluate(scored(spark, TIED)).first()
    assert row.pr_auc == pytest.approx(0.770833, abs=1e-6)
    assert (row.n_sample, row.prevalence) == (6, pytest.approx(4 / 6))


def test_average_precision_against_brute_force(spark, sample):
    for _ in range(2):
        assert ev.evaluate(frame(spark, sample)).first().pr_auc == pytest.approx(brute_ap(*sample), abs=1e-12)


def test_many_blocks_give_the_same_curve(spark, sample):
    one = ev.pr_curve(frame(spark, sample)).orderBy("threshold").collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = ev.pr_curve(frame(spark, sample)).orderBy("threshold").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert one == many and one[0].recall == 1.0


def test_all_positive_and_none(spark):
    assert ev.evaluate(scored(spark, [(0.1, 1), (0.9, 1)])).first().pr_auc == 1.0
    assert ev.evaluate(scored(spark, [(0.1, 0), (0.9, 0)])).first().pr_auc == 0.0


def test_threshold_is_the_lowest_that_meets_the_floor(spark):
    precision, recall, threshold = ev.find_threshold(scored(spark, TIED), 0.7)
    assert (precision, recall, threshold) == (0.75, 0.75, 0.6)
    with pytest.raises(ValueError):
        ev.find_threshold(scored(spark, [(0.9, 0), (0.5, 1)]), 0.9)


def test_precision_recall_at(spark):
    row = ev.precision_recall_at(scored(spark, TIED), 0.7).first()
    assert (row.n_flagged, row.precision, row.recall) == (3, pytest.approx(2 / 3), 0.5)


def test_floor_cost(spark):
    row = ev.floor_cost(scored(spark, TIED), 0.75, 0.6).first()
    assert row.share_flagged_high == pytest.approx(4 / 6) and row.share_flagged_low == 1.0
    assert (row.extra_flagged, row.extra_precision) == (2, 0.5)


def test_gate(spark):
    metrics = ev.evaluate(scored(spark, TIED))
    row = ev.gate(metrics, 0.64).first()
    assert row.passed and row.margin == pytest.approx(0.130833, abs=1e-6)
    assert ev.require_gate(metrics, 0.64) == pytest.approx(row.margin)
    with pytest.raises(CheckFailed):
        ev.require_gate(metrics, 0.9)


def direct_bootstrap(score, y, n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        idx = rng.integers(0, len(y), size=len(y))
        out.append(brute_ap(score[idx], y[idx]))
    return np.array(out)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_bootstrap_has_the_distribution_of_row_resampling(spark, coalesce):
    rng = np.random.default_rng(8)
    y = (rng.random(300) < 0.3).astype(int)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        df = frame(spark, (score, y))
        runs = ev.bootstrap_average_precision(df, 600, 42).toPandas()
        again = ev.bootstrap_average_precision(df, 600, 42).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(runs) == 600
    got = runs.sort_values("iteration").pr_auc.to_numpy()
    assert np.allclose(got, again.sort_values("iteration").pr_auc.to_numpy(), atol=1e-12)
    want = direct_bootstrap(score, y, 600, 1)
    assert abs(got.mean() - want.mean()) < 4 * want.std() / np.sqrt(600) * 1.5
    assert got.std() == pytest.approx(want.std(), rel=0.15)
    for q in (2.5, 50, 97.5):
        assert np.percentile(got, q) == pytest.approx(np.percentile(want, q), abs=want.std() * 0.4)


def tree_sums(pos, neg, at, levels):
    rows = []
    for level in range(levels):
        first = at >> (level + 1) << (level + 1)
        left, right = slice(first, first + 2**level), slice(first + 2**level, first + 2 ** (level + 1))
        rows.append((at, level, pos[left].sum(), neg[left].sum(), pos[right].sum(), neg[right].sum()))
    return pd.DataFrame(rows, columns=[ev.RANGE, "level", "left_pos", "left_neg", "right_pos", "right_neg"])


def test_paths_of_all_ranges_tell_one_draw(spark):
    rng = np.random.default_rng(3)
    pos, neg = rng.integers(0, 50, 11), rng.integers(0, 900, 11)
    pos[4] = neg[4] = pos[7] = 0  # no rows at all, no positives
    paths = [tree_sums(pos, neg, at, 4) for at in range(11)]
    cells = spark.createDataFrame([(i, int(pos[i]), int(neg[i])) for i in range(11) if i != 4], f"{ev.RANGE} long, pos long, neg long")
    got = ev._paths(cells, 4).toPandas().sort_values([ev.RANGE, "level"])[paths[0].columns]
    want = pd.concat([p for at, p in enumerate(paths) if at != 4])
    assert (got.to_numpy() == want.to_numpy()).all()
    n, before = pos.sum() + neg.sum(), np.zeros((2, 4000), np.int64)
    for at in range(11):
        drawn, above, hits = ev._draw_path(at, paths[at], 4000, 5)
        assert (above == before).all() and (drawn[:, 0] >= 0).all()
        before = before + drawn
        for side, have in enumerate((pos[at], neg[at])):
            share = have / n
            assert drawn[side].mean() == pytest.approx(n * share, abs=4 * np.sqrt(n * share * (1 - share) / 4000))
            assert drawn[side].var() == pytest.approx(n * share * (1 - share), rel=0.15)
    assert (before.sum(axis=0) == n).all() and (before[0] == hits).all()


def test_bootstrap_over_many_ranges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    y = (rng.random(300) < 0.3).astype(int)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    df = frame(spark, (score, y))
    monkeypatch.setattr(ev, "RANGE_ROWS", 16)
    got = ev.bootstrap_average_precision(df, 600, 42).toPandas().sort_values("iteration").pr_auc.to_numpy()
    other = ev.bootstrap_average_precision(df.repartition(5), 600, 42).toPandas().sort_values("iteration")
    assert len(got) == 600 and np.allclose(got, other.pr_auc.to_numpy(), atol=1e-12)
    want = direct_bootstrap(score, y, 600, 1)
    assert abs(got.mean() - want.mean()) < 4 * want.std() / np.sqrt(600) * 1.5
    assert got.std() == pytest.approx(want.std(), rel=0.15)
    with pytest.raises(ValueError, match="nothing to resample"):
        ev.bootstrap_average_precision(df.limit(0), 10, 42)


def test_bootstrap_band(spark, sample):
    row = ev.bootstrap_band(frame(spark, sample), 100, 42).first()
    assert row.p2_5 < row.p50 < row.p97_5
    assert row.p2_5 < brute_ap(*sample) < row.p97_5


def test_curve_is_a_dataframe_without_single_task_window(spark, sample, capsys):
    ev.pr_curve(frame(spark, sample)).explain("formatted")
    assert "_block" in capsys.readouterr().out
