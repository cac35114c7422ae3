"""One id is one stored request, whatever day it comes back on; equal records at two places are two."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from modelwatch.operators.checks import CheckFailed
from modelwatch.operators.scoring import identify
from modelwatch.sinks import ledger
from modelwatch.sinks import tables as sinks
from modelwatch.sources import files

T0 = dt.datetime(2024, 1, 1, 23, 59)
SCHEMA = "request_id string, customer_id string, prediction string, probability double, event_time timestamp"


def facts(spark, rows):
    return spark.createDataFrame([(i, c, "yes", p, T0 + dt.timedelta(days=d)) for i, c, p, d in rows], SCHEMA)


def stored(spark, path):
    return sorted((r.request_id, r.customer_id) for r in spark.read.parquet(path).collect())


def test_an_id_sent_again_on_another_day_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "f")
    assert sinks.append_predictions(facts(spark, [("R1", "a", 0.5, 0), ("R2", "b", 0.5, 0), ("R2", "b", 0.5, 3)]), path) == 2
    assert sinks.append_predictions(facts(spark, [("R1", "a", 0.7, 1), ("R3", "a", 0.5, 0)]), path) == 1
    assert sinks.append_predictions(facts(spark, [("R1", "a", 0.7, 9)]), path) == 0
    assert stored(spark, path) == [("R1", "a"), ("R2", "b"), ("R3", "a")]


def test_two_records_with_one_id_raise_and_leave_the_table(spark, tmp_path):
    path = str(tmp_path / "f")
    sinks.append_predictions(facts(spark, [("R1", "a", 0.5, 0)]), path)
    for bad in ([("R2", "a", 0.5, 0), ("R2", "b", 0.5, 0)], [("R1", "other", 0.5, 5)], [(None, "a", 0.5, 0)]):
        with pytest.raises(CheckFailed):
            sinks.append_predictions(facts(spark, [*bad, ("R9", "z", 0.5, 0)]), path)
    assert stored(spark, path) == [("R1", "a")]


def test_an_append_that_died_before_its_ledger_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f")
    sinks.append_predictions(facts(spark, [("R1", "a", 0.5, 0)]), path)
    add = ledger.KeyLedger.add

    def broken(self, keys):
        raise RuntimeError("lost")

    monkeypatch.setattr(ledger.KeyLedger, "add", broken)
    batch = facts(spark, [("R2", "b", 0.5, 0), ("R3", "c", 0.5, 2)])
    with pytest.raises(RuntimeError, match="lost"):
        sinks.append_predictions(batch, path)
    monkeypatch.setattr(ledger.KeyLedger, "add", add)
    assert sinks.append_predictions(batch, path) == 0
    assert sinks.append_predictions(facts(spark, [("R3", "c", 0.5, 40), ("R4", "d", 0.5, 0)]), path) == 1
    assert [i for i, _ in stored(spark, path)] == ["R1", "R2", "R3", "R4"]


def test_the_ledger_is_not_shuffled_and_can_be_compacted(spark, tmp_path, capsys):
    path = str(tmp_path / "f")
    for day in range(3):
        sinks.append_predictions(facts(spark, [(f"R{day}-{i}", "a", 0.5, day) for i in range(30)]), path)
    book = ledger.KeyLedger(spark, path, "request_id", "string")
    batch = facts(spark, [("R0-1", "a", 0.5, 7), ("new", "a", 0.5, 7)])
    batch = batch.withColumn("record", ledger.record_digest(batch.columns, "request_id"))
    plan = book.split(batch)
    plan.explain("formatted")
    text = capsys.readouterr().out
    assert "SortMergeJoin" in text and text.count(") Exchange\n") <= 1
    assert [r.request_id for r in plan.collect()] == ["new"]
    assert book.compact() == 90
    assert sum(f.name.endswith(".parquet") for f in (tmp_path / "f" / "_ledger" / "keys").iterdir()) <= ledger.BUCKETS
    book.close()
    assert sinks.append_predictions(facts(spark, [("R2-5", "a", 0.5, 50), ("R9", "a", 0.5, 0)]), path) == 1
    assert len(stored(spark, path)) == 91


def test_digests_tell_nulls_and_borders_apart(spark):
    df = spark.createDataFrame([("i", "a", "bc"), ("i", "ab", "c"), ("i", None, "abc"), ("i", "", "abc")], "k string, x string, y string")
    assert df.select(ledger.record_digest(df.columns, "k").alias("d")).distinct().count() == 4


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_equal_records_of_two_files_are_two_requests(spark, tmp_path, kind):
    records = spark.createDataFrame([("a", 1)] * 3 + [("b", 2)], "name string, v int")
    for name in ("one", "two"):
        records.coalesce(1).write.format(kind).save(str(tmp_path / name))

    def ids(name):
        rows = spark.read.schema("name string, v int").format(kind).load(str(tmp_path / name))
        return {r.request_id for r in identify(files.with_position(rows)).collect()}

    assert len(ids("one")) == 4 and ids("one") == ids("one") and not ids("one") & ids("two")


def test_records_from_no_file_are_told_apart_by_call(spark):
    records = spark.createDataFrame([("a", None), ("a", None), ("b", "given")], "name string, request_id string")
    first, second = ([r.request_id for r in identify(files.with_position(records)).collect()] for _ in range(2))
    assert len(set(first + second)) == 5 and first[2] == second[2] == "given"
    assert identify(files.with_position(records)).columns == records.columns


def shuffles(spark, work):
    context = spark.sparkContext._jsc.sc()
    first = context.newShuffleId()
    work()
    return context.newShuffleId() - first - 1


def test_an_append_shuffles_its_rows_by_id_once(spark, tmp_path, capsys):
    path = str(tmp_path / "f")
    batch = facts(spark, [(f"R{i}", "a", 0.5, i % 3) for i in range(60)])
    # By id, the facts by date; two counts and the days of the mark, a few rows each.
    assert shuffles(spark, lambda: sinks.append_predictions(batch, path)) <= 5
    assert shuffles(spark, lambda: sinks.append_predictions(batch, path)) <= 3
    book = ledger.KeyLedger(spark, path, "request_id", "string")
    again = facts(spark, [("R1", "a", 0.5, 7), ("new", "a", 0.5, 7), ("new", "a", 0.5, 8)])
    staged = book.stage(again).withColumn("record", ledger.record_digest(again.columns, "request_id"))
    fresh = ledger.unseen(staged, book)
    fresh.explain("formatted")
    text = capsys.readouterr().out
    assert "SortMergeJoin" in text and ") Exchange\n" not in text
    assert [r.request_id for r in fresh.collect()] == ["new"]
    book.close()
    keys = [f.name for f in (tmp_path / "f" / "_ledger" / "keys").iterdir() if f.name.endswith(".parquet")]
    assert len(keys) <= ledger.BUCKETS and len(stored(spark, path)) == 60


def test_a_staged_batch_is_dropped_with_its_append(spark, tmp_path, monkeypatch):
    path, folder = str(tmp_path / "f"), tmp_path / "f" / "_ledger" / "batch"
    with pytest.raises(CheckFailed):
        sinks.append_predictions(facts(spark, [("R1", "a", 0.5, 0), ("R1", "b", 0.5, 0)]), path)
    assert not folder.exists()
    monkeypatch.setattr(ledger.KeyLedger, "close", lambda self: None)  # died
    assert sinks.append_predictions(facts(spark, [("R1", "a", 0.5, 0)]), path) == 1
    assert folder.exists()
    monkeypatch.undo()
    assert sinks.append_predictions(facts(spark, [("R1", "a", 0.5, 0), ("R2", "b", 0.5, 0)]), path) == 1
    assert not folder.exists() and stored(spark, path) == [("R1", "a"), ("R2", "b")]


def test_the_shuffle_of_positions_carries_no_digest(spark, tmp_path, capsys):
    spark.createDataFrame([("a", 1)] * 3 + [("b", None)], "name string, v int").coalesce(1).write.json(str(tmp_path / "r"))
    placed = files.with_position(spark.read.schema("name string, v int").json(str(tmp_path / "r")))
    placed.explain("formatted")
    text = capsys.readouterr().out
    assert text.count(") Exchange\n") == 1
    assert "_w" not in text[text.index(") Exchange\n") :].split("\n\n")[0]
    (file,) = (f for f in (tmp_path / "r").iterdir() if f.name.endswith(".json"))
    wanted = {("a", f"file:{file}#{n}") for n in (1, 2, 3)} | {("b", f"file:{file}#1")}
    assert {(r.name, r.position) for r in placed.collect()} == wanted
