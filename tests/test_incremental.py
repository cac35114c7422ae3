"""Drift from stored counts against a full run."""

import pytest
from pyspark.sql import functions as F

from modelwatch.operators.checks import CheckFailed
from modelwatch.operators.drift import drift_metrics, fit_reference
from modelwatch.plans import incremental
from modelwatch.sinks import tables
from modelwatch.sources.files import read_traffic

SCHEMA = "request_id string, event_time timestamp, probability double, amount double, channel string, model_version string"


def facts(spark, first, n, start="2024-01-01"):
    row = f"CAST(id AS STRING), timestamp'{start}' + make_interval(0, 0, 0, CAST(id % 12 AS INT)), (id % 97) / 97"
    amount = "CASE WHEN id % 31 = 0 THEN NULL ELSE CAST(id * 7 % 113 AS DOUBLE) END, element_at(array('app', 'web', 'new'), CAST(id % 3 + 1 AS INT))"
    return spark.range(first, first + n).selectExpr(f"inline(array(struct({row}, {amount}, '1')))").toDF(
        *[c.split()[0] for c in SCHEMA.split(", ")]
    )


@pytest.fixture(scope="module")
def reference(spark):
    sample = facts(spark, 0, 800).withColumnRenamed("probability", "score")
    return fit_reference(sample, ["score", "amount"], {"channel": ["app", "web"]})


def rows(metrics):
    return {(r.day, r.feature, r.window_days): (pytest.approx(r.psi, abs=1e-12), r.n_rows) for r in metrics.collect()}


def full(spark, path, reference):
    return drift_metrics(read_traffic(spark.read.parquet(path), ["amount", "channel"]), reference)


def test_each_run_reads_new_files_only(spark, tmp_path, reference, monkeypatch):
    path, store, out = f"{tmp_path}/facts", f"{tmp_path}/counts", f"{tmp_path}/drift"
    seen = []
    count = incremental.daily_bin_counts
    monkeypatch.setattr(incremental, "daily_bin_counts", lambda t, r: seen.append(set(t.inputFiles())) or count(t, r))
    every = set()
    # New days, then rows of old days, then an empty day between.
    for first, start in ((0, "2024-01-01"), (1000, "2024-01-13"), (2000, "2024-01-03"), (3000, "2024-02-20")):
        tables.append_predictions(facts(spark, first, 500, start), path)
        got = incremental.incremental_drift_job(spark, path, store, reference, "1", out)
        files = set(spark.read.parquet(path).inputFiles())
        assert seen[-1] == files - every and seen[-1]
        every = files
        assert rows(full(spark, path, reference)) == rows(got)
    again = incremental.incremental_drift_job(spark, path, store, reference, "1", out)
    assert len(seen) == 4 and rows(full(spark, path, reference)) == rows(again)


def test_a_run_that_died_and_many_runs(spark, tmp_path, reference, monkeypatch):
    path, store = f"{tmp_path}/facts", f"{tmp_path}/counts"

    def update():
        return incremental.update_counts(spark, path, store, reference, lambda t: read_traffic(t, ["amount", "channel"]))

    facts(spark, 0, 60).coalesce(1).write.parquet(path)
    store_segment = incremental.store_segment
    monkeypatch.setattr(incremental, "store_segment", lambda rows, i, folder: rows.write.parquet(f"{folder}/{i}-{i}"))
    assert len(update()) == 1
    assert incremental.stored_counts(spark, store, reference).count() == 0
    # Of 4 runs each, segments are merged.
    monkeypatch.setattr(incremental, "store_segment", lambda *a: store_segment(*a, fan_in=4))
    assert len(update()) == 1 and update() == []
    for i in range(1, 6):
        facts(spark, 100 * i, 20).coalesce(1).write.mode("append").parquet(path)
        assert len(update()) == 1
    want = incremental.daily_bin_counts(read_traffic(spark.read.parquet(path), ["amount", "channel"]), reference)
    got = incremental.stored_counts(spark, store, reference)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert len(incremental.current_segments(spark, incremental.counts_folder(store, reference))) == 3


def test_refusals(spark, tmp_path, reference):
    path, store = f"{tmp_path}/facts", f"{tmp_path}/counts"
    facts(spark, 0, 30).withColumn("model_version", F.lit("2")).write.parquet(path)
    with pytest.raises(CheckFailed):
        incremental.incremental_drift_job(spark, path, store, reference, "1", f"{tmp_path}/drift")
    assert incremental.stored_counts(spark, store, reference).count() == 0
    incremental.incremental_drift_job(spark, path, store, reference, "2", f"{tmp_path}/drift")
    facts(spark, 0, 30).write.mode("overwrite").parquet(path)
    with pytest.raises(CheckFailed, match="gone"):
        incremental.uncounted(spark.read.parquet(path), store, reference)
