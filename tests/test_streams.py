import datetime as dt

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import drift, latency
from modelwatch.streaming import facts, telemetry

T0 = dt.datetime(2024, 1, 1)


def write_batches(spark, rows, schema, folder, n):
    """n files, in order of arrival."""
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, df, tmp_path, name):
    facts.run_available(facts.append_to(df, str(tmp_path / name), str(tmp_path / f"{name}-state")))
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


LOG = "path string, status_code int, duration_ms double, created_at timestamp"


def test_windowed_histogram_equals_batch_on_closed_windows(spark, tmp_path):
    rows = [("/p" if i % 3 else "/h", 200, float(i % 400), T0 + dt.timedelta(minutes=i)) for i in range(600)]
    write_batches(spark, rows, LOG, str(tmp_path / "in"), 4)
    got = run(spark, telemetry.windowed_histogram(stream(spark, str(tmp_path / "in"), LOG), "1 hour", "10 minutes"), tmp_path, "hist")
    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("bucket", F.date_trunc("hour", "created_at").cast("timestamp_ntz"))
    closed = latency.latency_histogram(batch.filter(F.col("bucket") < F.lit(T0 + dt.timedelta(hours=9))), ["bucket", "path"])
    assert sorted(got.collect()) == sorted(closed.collect())


def test_rates(spark, tmp_path):
    rows = [("/p", 500 if i % 4 == 0 else 200, 1.0, T0 + dt.timedelta(minutes=i)) for i in range(180)]
    write_batches(spark, rows, LOG, str(tmp_path / "in"), 2)
    got = run(spark, telemetry.windowed_service_rates(stream(spark, str(tmp_path / "in"), LOG), "1 hour", 3600, "5 minutes"), tmp_path, "rates")
    assert {(r.per_second, r.server_error_ratio) for r in got.collect()} == {(60 / 3600, 0.25)}


def test_repeated_requests_are_kept_once(spark, tmp_path):
    schema = "request_id string, event_time timestamp, score double"
    rows = [(f"r{i % 50}", T0 + dt.timedelta(seconds=i % 50), 0.5) for i in range(150)]
    write_batches(spark, rows, schema, str(tmp_path / "in"), 3)
    late = spark.createDataFrame([("late", T0 - dt.timedelta(days=9), 0.5), ("r7", T0 + dt.timedelta(seconds=7), 0.5)], schema)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = stream(spark, str(tmp_path / "in"), schema)
    facts.run_available(facts.append_unseen(got, str(tmp_path / "once"), str(tmp_path / "once-state")))
    got = spark.read.parquet(str(tmp_path / "once"))
    assert got.count() == 51 and got.select("request_id").distinct().count() == 51


def test_running_results_equal_batch_on_all_windows(spark, tmp_path):
    rows = [("/p" if i % 3 else "/h", 200, float(i % 400), T0 + dt.timedelta(minutes=i)) for i in range(600)]
    write_batches(spark, rows, LOG, str(tmp_path / "in"), 4)
    running = telemetry.windowed_histogram(stream(spark, str(tmp_path / "in"), LOG), "1 hour", "10 minutes")
    facts.run_available(facts.upsert_to(running, str(tmp_path / "now"), str(tmp_path / "now-state")))
    got = facts.read_upserts(spark, str(tmp_path / "now"), running.schema, ["bucket", "path", "le_ord"])
    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("bucket", F.date_trunc("hour", "created_at").cast("timestamp_ntz"))
    assert sorted(got.collect()) == sorted(latency.latency_histogram(batch, ["bucket", "path"]).collect())


def test_drift_counts_equal_batch_on_closed_days(spark, tmp_path):
    schema = "event_time timestamp, x double, c string"
    rows = [(T0 + dt.timedelta(hours=i), float(i % 13), "ab"[i % 2]) for i in range(24 * 12)]
    write_batches(spark, rows, schema, str(tmp_path / "in"), 5)
    batch = spark.read.parquet(str(tmp_path / "in"))
    reference = drift.fit_reference(batch, ["x"], {"c": ["a", "b"]})
    daily = run(spark, facts.daily_bin_stream(stream(spark, str(tmp_path / "in"), schema), reference, "1 hour"), tmp_path, "bins")
    closed = batch.withColumn("day", F.to_date("event_time")).filter("day < date'2024-01-12'")
    want = drift.daily_bin_counts(closed, reference)
    assert sorted(daily.collect()) == sorted(want.collect())
    got = drift.rolling_psi(daily, reference).collect()
    assert sorted(got) == sorted(drift.drift_metrics(closed, reference).collect())


@pytest.mark.parametrize("files", [1, 3])
def test_label_join_waits_for_the_observation_period_only(spark, tmp_path, files):
    p_schema = "request_id int, event_time timestamp, prediction string"
    l_schema = "request_id int, label int, available_at timestamp"
    preds = [(i, T0 + dt.timedelta(days=i), "yes") for i in range(30)]
    labels = [(i, 1, T0 + dt.timedelta(days=i + (i % 100 if i != 7 else 95))) for i in range(30)]
    write_batches(spark, preds, p_schema, str(tmp_path / "p"), files)
    write_batches(spark, labels, l_schema, str(tmp_path / "l"), files)
    joined = facts.join_labels(
        stream(spark, str(tmp_path / "p"), p_schema), stream(spark, str(tmp_path / "l"), l_schema), 90, "120 days"
    )
    got = run(spark, joined, tmp_path, "joined")
    assert sorted(r.request_id for r in got.collect()) == [i for i in range(30) if i != 7]
