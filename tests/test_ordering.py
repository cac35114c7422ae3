import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modelwatch.operators.ordering import cut_blocks, exact_percentiles, order_blocks, running_totals, sketch_cuts

FRACTIONS = {"p0": 0.0, "p5": 0.05, "p45": 0.45, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def disc(sample, q):
    ordered = np.sort(sample)
    return ordered[max(math.ceil(q * len(ordered)), 1) - 1]


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows in one group, many ties, a tiny group and nulls."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.round(rng.lognormal(size=4000), 2)]
    rows += [(f"g{i % 40}", float(v)) for i, v in enumerate(rng.normal(size=6000))]
    rows += [("same", 5.0)] * 1500 + [("tiny", 1.0), ("tiny", 2.0), ("tiny", 4.0)]
    rows += [("hot", None), ("tiny", None)]
    return pd.DataFrame(rows, columns=["g", "v"])


@pytest.mark.parametrize("segments", [2, 64])
@pytest.mark.parametrize("kind", ["disc", "linear"])
def test_percentiles_by_group(spark, skewed, kind, segments):
    df = spark.createDataFrame(skewed.astype(object).where(skewed.notna(), None).values.tolist(), "g string, v double")
    got = exact_percentiles(df.repartition(7), "v", FRACTIONS, ["g"], kind, segments, accuracy=200).toPandas()
    assert len(got) == skewed.g.nunique()
    for _, row in got.iterrows():
        sample = skewed[(skewed.g == row.g)].v.dropna().to_numpy()
        assert row.n == len(sample)
        for name, q in FRACTIONS.items():
            want = disc(sample, q) if kind == "disc" else np.percentile(sample, q * 100)
            assert row[name] == pytest.approx(want, rel=1e-12), (row.g, name)


def test_percentiles_of_one_to_ten(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    row = exact_percentiles(df, "v", {"a": 0.45, "b": 0.5, "c": 0.95}).first()
    assert (row.n, row.a, row.b, row.c) == (10, 5.0, 5.0, 10.0)


def test_coarse_sketch_is_still_exact(spark):
    """A poor sketch makes segments uneven; the answer still is the exact order statistic."""
    df = spark.range(0, 200_000, 1, 8).select((F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    sample = df.toPandas().v.to_numpy()
    row = exact_percentiles(df, "v", {"p50": 0.5, "p99": 0.99}, accuracy=1000).first()
    assert (row.p50, row.p99) == (disc(sample, 0.5), disc(sample, 0.99))


def test_small_groups_shuffle_no_more_rows_than_they_hold(spark):
    df = spark.range(30_000).select((F.col("id") % 3000).alias("g"), F.rand(1).alias("v"))
    got = exact_percentiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.9}, ["g"])
    assert got.count() == 3000 and got.filter("n <> 10 OR a > b OR b > c").count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_blocks(spark, descending):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pdf = pd.DataFrame({"g": ["a"] * 900 + ["b"] * 30 + [None] * 70, "o": range(1000), "m": range(1, 1001)})
        df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "g string, o int, m int")
        blocks = order_blocks(df, ["g"], "o", descending)
        assert blocks.select("_block").distinct().count() > 1
        got = running_totals(blocks, ["g"], "o", ["m"], descending).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = pdf.sort_values("o", ascending=not descending)
    want = want.assign(cum=want.groupby("g", dropna=False).m.cumsum()).sort_values("o").cum.tolist()
    assert got.sort_values("o").cum_m.tolist() == want


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert exact_percentiles(df, "v", {"p": 0.5}, ["g"]).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_literal_cuts(spark, descending, capsys):
    values = [None, float("nan"), float("inf"), -float("inf"), *[i / 7 for i in range(500)]]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "o double, m int").repartition(5)
    cuts = sketch_cuts(df, "o", 8)
    assert cuts == sorted(set(cuts)) and len(cuts) == 7
    blocks = cut_blocks(df, "o", cuts, descending)
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert len(sizes) == 9 and max(sizes) < 80
    totals = running_totals(blocks, [], "o", ["m"], descending)
    totals.explain()
    assert "checkpoint" not in capsys.readouterr().out.lower()
    order = F.col("o").desc_nulls_last() if descending else F.col("o").asc_nulls_first()
    want, total = [], 0
    for r in df.orderBy(order).collect():
        total += r.m
        want.append((r.m, total))
    assert [(r.m, r.cum_m) for r in totals.orderBy(order).collect()] == want


def test_cuts_of_one_value_and_of_nothing(spark):
    same = spark.range(100).select(F.lit(2.0).alias("o"), F.lit(1).alias("m"))
    assert sketch_cuts(same, "o", 8) == [2.0]
    assert {r["_block"] for r in cut_blocks(same, "o", [2.0]).collect()} == {0}
    assert sketch_cuts(same.limit(0), "o", 8) == [] == sketch_cuts(same, "o", 1)
    assert running_totals(cut_blocks(same.limit(0), "o", []), [], "o", ["m"]).count() == 0
