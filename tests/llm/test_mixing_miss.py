"""Sources come near their targets although long documents stay open last."""

import random

import pytest

from modelwatch.llm import mixing
from modelwatch.llm.common import table


def test_settled_sums_are_near(spark):
    rng = random.Random(2)
    for _ in range(300):
        sizes = [rng.choice([1, 3, 10, 40, 900]) for _ in range(rng.randrange(1, 60))]
        parts = [float(rng.random() < 0.5) for _ in sizes]
        miss = rng.uniform(-600, 600)
        got, left = mixing.settle_miss(sizes, parts, miss)
        assert set(got) <= {0.0, 1.0}
        moved = sum(s * (g - p) for s, g, p in zip(sizes, got, parts, strict=True))
        assert left == pytest.approx(miss - moved) and abs(left) <= abs(miss)


def test_no_change_without_a_miss():
    assert mixing.settle_miss([5, 3, 0], [1.0, 0.0, 0.0], 0.0) == ([1.0, 0.0, 0.0], 0.0)
    assert mixing.settle_miss([], [], 4.0) == ([], 4.0)


@pytest.mark.parametrize("chunk_rows", [4_096, 16])
def test_targets_are_met_but_for_short_documents(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk_rows)
    rows = [(i, "word " * (150 if i % 50 == 0 else 1 + i % 7), "ab"[i % 3 == 0]) for i in range(600)]
    rows += [(900 + i, "w " * (1 + i % 5), None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(7)).collect()}
    assert {(r.doc_id, r.copies) for r in got} == again and len(got) == len(rows)
    for source in ("a", "b", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 7
    assert all(r.copies <= 2 for r in got)


def test_given_table_meets_its_targets(spark):
    got = mixing.mix(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        taken = sum(r.size * r.copies for r in own)
        assert taken == pytest.approx(own[0].target, rel=0.003)
