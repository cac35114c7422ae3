"""Parity by digests against comparing every row."""

import random

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import parity
from modelwatch.operators.checks import CheckFailed

NAN, INF = float("nan"), float("inf")


def brute(a, e, tolerance):
    """Keys of unique rows that lack a partner or differ."""
    off = []
    for k in a.keys() | e.keys():
        if k not in a or k not in e:
            off.append(k)
            continue
        for x, y in zip(a[k], e[k]):
            if (x is None) != (y is None) or (x is not None and not abs(x - y) <= tolerance):
                off.append(k)
                break
    return sorted(off)


@pytest.mark.parametrize("tolerance", [1e-9, 0.25, 0.0])
def test_offenders_equal_brute_force(spark, tolerance):
    rng = random.Random(5)
    odd = [None, 0.0, -0.0, NAN, INF, -INF, 1e300, 6e5, 3e-4, 0.125, 1e17]
    a = {k: (rng.choice(odd), rng.uniform(-3, 3)) for k in range(900)}
    e = {k: v for k, v in a.items() if k % 50}
    for k in list(e)[::3]:
        x, y = e[k]
        e[k] = rng.choice([(x, y + rng.choice([1e-10, 2e-9, 0.2, 0.3])), (y, x), (rng.choice(odd), y), (None, y)])
    e[-1] = (None, None)
    schema = "k long, x double, y double"
    left = spark.createDataFrame([(k, *v) for k, v in a.items()], schema)
    right = spark.createDataFrame([(k, *v) for k, v in e.items()], schema)
    got = parity.parity_offenders(left, right, "k", {"x": "x", "y": "y"}, tolerance, buckets=256)
    assert sorted(r.k for r in got.select("k").collect()) == brute(a, e, tolerance)


def test_equal_tables_are_compared_without_their_rows(spark, tmp_path):
    spark.range(5000).selectExpr("id AS k", "id / 7 AS x").write.parquet(f"{tmp_path}/t")
    a = spark.read.parquet(f"{tmp_path}/t")
    near = a.withColumn("x", F.col("x") + 1e-13).orderBy(F.desc("k"))
    got = parity.parity_offenders(a, near, "k", {"x": "x"}, 1e-3)
    assert got.count() == 0 and parity.unlike_rows(a, a.orderBy(F.desc("k"))) is None
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan and "parquet" not in plan.lower()


def test_null_and_repeated_keys(spark):
    schema = "k string, x double"
    a = spark.createDataFrame([(None, 1.0), ("a", 1.0), ("a", 2.0), ("b", 1.0)], schema)
    same = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("a", 1.0), ("b", 1.0)], schema)
    keys = [r.k for r in parity.parity_offenders(a, same, "k", {"x": "x"}).collect()]
    assert keys == [None, None]
    more = same.unionAll(spark.createDataFrame([("a", 2.0)], schema)).filter("k IS NOT NULL")
    got = parity.parity_offenders(a.filter("k IS NOT NULL"), more, "k", {"x": "x"}).collect()
    assert [(r.k, r.actual_x, r.expected_x) for r in got] == [("a", None, 2.0)]


def test_rows_that_hold_the_same_values_elsewhere(spark):
    schema = "a int, b int, c array<int>, d struct<p:int,q:int>"
    left = spark.createDataFrame([(1, None, [1, None], (1, None)), (2, 2, None, None)], schema)
    for row in [(None, 1, [1, None], (1, None)), (1, None, [None, 1], (1, None)), (1, None, [1, None], (None, 1))]:
        right = spark.createDataFrame([row, (2, 2, None, None)], schema)
        assert {r.surplus for r in parity.unlike_rows(left, right).collect()} == {1, -1}
    one = left.filter("a = 1")
    with pytest.raises(CheckFailed, match="1 rows are missing, 2 are not"):
        parity.require_same_rows(one.unionAll(one).unionAll(one), left, "t")
    parity.require_same_rows(left, left.orderBy("a"), "t")
    parity.require_same_rows(left.limit(0), left.limit(0), "t")
