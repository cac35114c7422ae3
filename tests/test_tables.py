import datetime as dt

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import checks, joins
from modelwatch.operators.checks import CheckFailed
from modelwatch.schemas import OUTCOME_LABELS, REQUEST_LOG, SERVICE_LOG
from modelwatch.sinks import tables as sinks
from modelwatch.sources import files, jdbc

T0 = dt.datetime(2024, 1, 1, 10)


def facts(spark, n=40):
    rows = [(f"r{i}", f"c{i % 7}", "yes", 0.5, T0 + dt.timedelta(days=i % 4)) for i in range(n)]
    return spark.createDataFrame(rows, "request_id string, customer_id string, prediction string, probability double, event_time timestamp")


def test_append_and_pruned_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "p")
    sinks.append_predictions(facts(spark), path)
    sinks.append_predictions(facts(spark, 8), path)
    table = spark.read.parquet(path)
    assert table.count() == 40  # the second batch was stored before
    late = facts(spark, 2).withColumn("request_id", F.concat(F.lit("late"), "request_id"))
    sinks.append_predictions(late.union(late), path)
    assert spark.read.parquet(path).count() == 42
    table.filter("event_date = date'2024-01-02'").explain("formatted")
    assert "PartitionFilters: [isnotnull(event_date" in capsys.readouterr().out
    assert files.read_prediction_keys(table).columns == ["request_id", "customer_id", "event_time"]


def test_request_log_is_best_effort(spark, tmp_path):
    row = spark.createDataFrame([("r", "POST", "/predict", 200, 5.0, None, None, None, T0)], REQUEST_LOG)
    assert sinks.append_request_log(row, str(tmp_path / "log"))
    (tmp_path / "file").write_text("not a folder")
    assert not sinks.append_request_log(row, str(tmp_path / "file" / "log"))


def test_replace_keeps_readers_on_whole_refreshes(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.replace_table(spark.range(5), path)
    before = files.read_latest(spark, path)
    assert before.count() == 5
    sinks.replace_table(spark.range(3), path)
    assert files.read_latest(spark, path).count() == 3


def test_guarded_write(spark, tmp_path):
    path = str(tmp_path / "g")
    assert sinks.is_empty(spark, path)
    sinks.write_guarded(spark.range(3), path)
    with pytest.raises(CheckFailed):
        sinks.write_guarded(spark.range(4), path)
    sinks.write_guarded(spark.range(4), path, reset=True)
    assert spark.read.parquet(path).count() == 4


def test_labels_must_cover_predictions(spark, tmp_path):
    rows = [(f"r{i}", 1, T0) for i in range(40)]
    labels = spark.createDataFrame(rows, OUTCOME_LABELS)
    sinks.append_labels(labels, facts(spark), str(tmp_path / "l"))
    path = str(tmp_path / "l")
    with pytest.raises(CheckFailed):
        sinks.append_labels(labels, facts(spark), path)
    # One label twice and one missing: the counts agree, the keys do not.
    swapped = labels.filter("request_id <> 'r3'").union(labels.filter("request_id = 'r4'"))
    other = spark.createDataFrame([("x", 1, T0)], OUTCOME_LABELS)
    for bad in (swapped, labels.withColumn("label", F.lit(2).cast("short")), labels.union(other)):
        with pytest.raises(CheckFailed):
            sinks.append_labels(bad, facts(spark), str(tmp_path / "never"))
    assert spark.read.parquet(path).count() == 40 and sinks.is_empty(spark, str(tmp_path / "never"))


def test_bucketed_facts_join_without_a_shuffle(spark, capsys):
    spark.sql("DROP TABLE IF EXISTS bucketed_p")
    spark.sql("DROP TABLE IF EXISTS bucketed_l")
    p = facts(spark)
    sinks.save_bucketed(p, "bucketed_p", "request_id", 4)
    sinks.save_bucketed(p.select("request_id", F.lit(1).alias("label"), F.col("event_time").alias("available_at")), "bucketed_l", "request_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.asof_labels(spark.table("bucketed_p"), spark.table("bucketed_l"), F.current_timestamp())
        joined.explain("formatted")
        assert "Exchange" not in capsys.readouterr().out
        assert joined.count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_service_log_scan(spark, tmp_path):
    line = '{"request_id": "a", "path": "/predict", "status_code": 200, "duration_ms": 12.5, "model_version": "1", "outcome": null}'
    (tmp_path / "log.json").write_text(line + "\n")
    row = files.read_service_log(spark, str(tmp_path)).first()
    assert (row.status_code, row.duration_ms, row.outcome) == (200, 12.5, None)
    assert files.read_service_log(spark, str(tmp_path)).schema == SERVICE_LOG


def test_connection_options():
    full = jdbc.connection_options({"DATABASE_URL": "postgresql+psycopg://u:p%40ss@db:5433/shop", "DB_NAME": "x"})
    assert full["url"] == "jdbc:postgresql://db:5433/shop"
    assert (full["user"], full["password"]) == ("u", "p@ss")
    parts = jdbc.connection_options({"DB_USER": "u", "DB_PASSWORD": "p", "DB_NAME": "shop"})
    assert parts["url"] == "jdbc:postgresql://localhost:5432/shop" and parts["user"] == "u"
    with pytest.raises(ValueError):
        jdbc.connection_options({})


def test_joins_enforce_cardinality(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    two = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, w int")
    with pytest.raises(CheckFailed, match="not unique"):
        joins.join_one_to_one(one, two, "k")
    with pytest.raises(CheckFailed, match="found no partner"):
        joins.join_one_to_one(one, two.filter("k = 'a' and w = 1"), "k")
    assert joins.attach_truth(two, one, "k", "k", "v").count() == 3
    with pytest.raises(CheckFailed, match="have no truth"):
        joins.attach_truth(two, one.filter("k = 'a'"), "k", "k", "v")
    with pytest.raises(CheckFailed, match="not unique"):
        joins.attach_truth(one, two, "k", "k", "w")


def test_parity_finds_missing_null_and_distant_rows(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None), (4, 1.0)], "id int, s double")
    e = spark.createDataFrame([(1, 0.5 + 5e-10), (2, 0.5 + 2e-9), (3, 0.1), (5, 1.0)], "id int, x double")
    bad = [r.id for r in joins.row_parity(a, e, "id", {"s": "x"}).orderBy("id").collect()]
    assert bad == [2, 3, 4, 5]


def test_version_guard(spark):
    one = spark.createDataFrame([(1,), (1,)], "model_version int")
    checks.require_single_version(one, "1")
    with pytest.raises(CheckFailed):
        checks.require_single_version(one, "2")
    with pytest.raises(CheckFailed):
        checks.require_single_version(one.union(spark.createDataFrame([(2,)], "model_version int")), "1")
    assert not checks.single_version_report(one.limit(0), "1").first().passes


def test_checks(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, float("nan")), ("b", None, None)], "k string, v int, x double")
    assert [(r.k, r.n_rows) for r in checks.duplicate_keys(df, ["k"]).collect()] == [("a", 2)]
    assert {r.column_name: r.n_missing for r in checks.null_counts(df, ["v", "x"]).collect()} == {"v": 1, "x": 2}
    assert checks.outside_domain(df, "v", [1, 2]).count() == 1
    assert checks.orphans(df, df.filter("k = 'a'"), "k").count() == 1
    with pytest.raises(CheckFailed):
        checks.require_empty(df, "rows left")
