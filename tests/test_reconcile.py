import datetime as dt

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import reconcile
from modelwatch.operators.joins import asof_labels

BASE = dt.datetime(2024, 1, 1)


def day(n, hour=12):
    return BASE + dt.timedelta(days=n, hours=hour)


@pytest.fixture(scope="module")
def facts(spark):
    preds, labels = [], []
    for i in range(300):
        t = day(i % 30)
        label = 1 if i % 3 == 0 else 0
        delay = 1 + i % 90 if label else 90
        preds.append((i, t, "yes" if i % 2 else "no"))
        labels.append((i, label, t + dt.timedelta(days=delay)))
    p = spark.createDataFrame(preds, "request_id int, event_time timestamp_ntz, prediction string")
    lab = spark.createDataFrame(labels, "request_id int, label int, available_at timestamp_ntz")
    return p, lab, preds, labels


def test_vantage_points_against_brute_force(facts):
    p, lab, preds, labels = facts
    by_id = {i: (y, a) for i, y, a in labels}
    end = BASE + dt.timedelta(days=14)
    cohort = [(x, *by_id[i]) for i, t, x in preds if BASE + dt.timedelta(days=7) <= t < end]
    rows = reconcile.cohort_by_vantage(p, lab, "yes", places=9).collect()
    assert [r.days_after_week for r in rows] == [7, 21, 45, 70, 90, 120]
    for r in rows:
        known = [(x, y) for x, y, a in cohort if a <= end + dt.timedelta(days=r.days_after_week)]
        hits = sum(x == "yes" and y == 1 for x, y in known)
        flagged, positives = sum(x == "yes" for x, _ in known), sum(y for _, y in known)
        assert (r.n_predictions, r.n_labelled) == (len(cohort), len(known))
        assert r.as_of == (end + dt.timedelta(days=r.days_after_week)).date()
        assert r.precision == (pytest.approx(hits / flagged, abs=1e-9) if flagged else None)
        assert r.recall == (pytest.approx(hits / positives, abs=1e-9) if positives else None)
    coverage = [r.coverage_pct for r in rows]
    assert coverage == sorted(coverage) and coverage[-1] == 100.0


def test_unwritten_labels_lower_coverage_only_with_left_join(facts):
    p, lab, _, _ = facts
    partial = lab.filter("request_id % 2 = 0")
    inner = reconcile.cohort_by_vantage(p, partial, "yes").collect()
    left = reconcile.cohort_by_vantage(p, partial, "yes", how="left").collect()
    assert inner[-1].coverage_pct == 100.0
    assert left[-1].coverage_pct < 60 and left[-1].n_labelled == inner[-1].n_labelled


def test_label_at_the_very_moment_counts(spark):
    p = spark.createDataFrame([(1, BASE, "yes")], "request_id int, event_time timestamp_ntz, prediction string")
    lab = spark.createDataFrame([(1, 1, day(5, 0))], "request_id int, label int, available_at timestamp_ntz")
    at = asof_labels(p, lab, F.lit("2024-01-06 00:00:00").cast("timestamp_ntz")).first()
    before = asof_labels(p, lab, F.lit("2024-01-05 23:59:59").cast("timestamp_ntz")).first()
    assert at.revealed and not before.revealed


def test_weekly_and_mature(facts):
    p, lab, preds, labels = facts
    weeks = reconcile.weekly_cohorts(p, lab, "yes").collect()
    assert sum(r.n_predictions for r in weeks) == 300 and weeks[0].prediction_week == dt.date(2024, 1, 1)
    periods = reconcile.mature_quality(p, lab, "yes").collect()
    assert [r.period for r in periods] == ["baseline", "ramp"] and sum(r.n for r in periods) == 300


def test_zoned_times_work_too(spark, facts):
    p, lab, _, _ = facts
    zoned_p = p.withColumn("event_time", F.col("event_time").cast("timestamp"))
    zoned_l = lab.withColumn("available_at", F.col("available_at").cast("timestamp"))
    for f in (reconcile.cohort_by_vantage, reconcile.weekly_cohorts, reconcile.mature_quality):
        assert f(zoned_p, zoned_l, "yes").collect() == f(p, lab, "yes").collect()
    assert reconcile.labels_available(zoned_p, zoned_l).count() == reconcile.labels_available(p, lab).count()


def test_delay_per_class(facts):
    p, lab, _, _ = facts
    rows = {r.label: r for r in reconcile.label_delay(p, lab).collect()}
    assert (rows[0].min_days, rows[0].max_days) == (90.0, 90.0) and rows[1].min_days == 1.0


def test_maturation(spark):
    p = spark.createDataFrame([(i, BASE) for i in range(5)], "request_id int, event_time timestamp_ntz")
    outcomes = spark.createDataFrame(
        [(0, day(3)), (0, day(9)), (1, day(90, 0)), (2, day(91, 0)), (3, day(-2))],
        "request_id int, outcome_at timestamp_ntz",
    )
    got = {r.request_id: (r.label, r.available_at) for r in reconcile.mature_labels(p, outcomes).collect()}
    closes = day(90, 0)
    assert got == {0: (1, day(3)), 1: (1, closes), 2: (0, closes), 3: (0, closes), 4: (0, closes)}


def test_cohort_filter_reaches_the_scan(spark, facts, tmp_path, capsys):
    p, lab, _, _ = facts
    p.write.parquet(str(tmp_path / "p"))
    lab.write.parquet(str(tmp_path / "l"))
    read = spark.read.parquet
    reconcile.cohort_by_vantage(read(str(tmp_path / "p")), read(str(tmp_path / "l")), "yes").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(event_time,2024-01-08" in plan and "LessThan(event_time,2024-01-15" in plan


def test_date_folders_are_pruned(spark, facts, tmp_path, capsys):
    p, lab, _, _ = facts
    p.withColumn("event_date", F.to_date("event_time")).write.partitionBy("event_date").parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))
    pruned = reconcile.cohort_by_vantage(table, lab, "yes")
    pruned.explain("formatted")
    assert "event_date#" in capsys.readouterr().out.split("PartitionFilters: [")[1].split("]")[0]
    assert pruned.collect() == reconcile.cohort_by_vantage(p, lab, "yes").collect()


def test_no_predictions(facts):
    p, lab, _, _ = facts
    assert reconcile.cohort_by_vantage(p.limit(0), lab, "yes").count() == 0
    assert reconcile.mature_quality(p.limit(0), lab, "yes").count() == 0
