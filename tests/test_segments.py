"""Segments of running results: bounded number, newest rows, repeats after a failure."""

import pytest

from modelwatch.streaming import segments

SCHEMA = "k int, g string, v long"


def batch(spark, i):
    rows = [(k, None if k % 5 == 0 else "g", 1000 * i + k) for k in range(i % 7, 30, 3)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def state(spark, path):
    schema = batch(spark, 0).schema
    return sorted((r.k, r.v) for r in segments.read_segments(spark, path, schema, ["k", "g"]).collect())


@pytest.mark.parametrize("keys", [("k", "g"), ()])
def test_merged_segments_hold_the_newest_rows(spark, tmp_path, keys):
    path, want = str(tmp_path / "t"), {}
    assert state(spark, path) == []
    for i in range(29):
        segments.store_segment(batch(spark, i), i, path, keys, 3)
        want |= {r.k: r.v for r in batch(spark, i).collect()}
        current = segments.current_segments(spark, path)
        assert len(current) <= 2 * 4 and [n for a, b in current for n in range(a, b + 1)] == list(range(i + 1))
    assert state(spark, path) == sorted(want.items())
    assert segments.current_segments(spark, path) == [(0, 26), (27, 27), (28, 28)]
    # Parts of earlier merges are gone, those of the last one of each size still there.
    folders = {p.name for p in (tmp_path / "t").iterdir() if p.name != segments.MARKERS}
    assert folders == {p.name for p in (tmp_path / "t" / segments.MARKERS).iterdir() if not p.name.startswith(".")}
    assert "0-0" not in folders and "24-24" in folders and len(folders) < 20


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(9):
        segments.store_segment(batch(spark, i), i, path, ["k", "g"], 3)
    before = state(spark, path)
    segments.store_segment(batch(spark, 8), 8, path, ["k", "g"], 3)
    assert state(spark, path) == before
    # A merge that died before its marker: readers take the parts, the repeated micro-batch merges again.
    (tmp_path / "t" / segments.MARKERS / "0-8").unlink()
    assert segments.current_segments(spark, path) == [(0, 2), (3, 5), (6, 8)] and state(spark, path) == before
    segments.store_segment(batch(spark, 8), 8, path, ["k", "g"], 3)
    assert segments.current_segments(spark, path) == [(0, 8)] and state(spark, path) == before


def test_a_thousand_micro_batches_leave_few_segments(spark, tmp_path, monkeypatch):
    put, have = [], set()
    monkeypatch.setattr(segments, "_put", lambda rows, path, a, b: (put.append((a, b)), have.add((a, b))))
    monkeypatch.setattr(segments, "_remove", lambda s, path, a, b: have.discard((a, b)))
    monkeypatch.setattr(segments, "_names", lambda s, path: sorted(have))
    monkeypatch.setattr(segments, "_merged", lambda rows, keys, fan_in: rows)
    empty = str(tmp_path / "empty")
    one = batch(spark, 0)
    one.write.parquet(empty)
    reader = type("R", (), {"schema": lambda self, s: self, "parquet": lambda self, *p: one})()
    fake = type("B", (), {"sparkSession": type("S", (), {"read": reader})(), "schema": one.schema, "withColumn": lambda self, *a: one})()
    for i in range(1000):
        segments.store_segment(fake, i, empty, ["k"])
    current = segments.current_segments(spark, empty)
    assert [n for a, b in current for n in range(a, b + 1)] == list(range(1000))
    assert len(current) <= 3 + 15 + 15 and len(have) <= 100 and len(put) == 1000 + 62 + 3
