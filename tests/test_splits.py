import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import profile
from modelwatch.operators.splits import DEFAULT_STEPS, allot, quotas, split_summary, stratified_split


@pytest.fixture(scope="module")
def people(spark):
    """One class holds most rows, one only a handful."""
    rows = [(f"c{i:05d}", "No" if i % 10 < 7 else "Yes", i % 73) for i in range(5000)]
    rows += [(f"x{i}", "Rare", 10) for i in range(5)]
    return spark.createDataFrame(rows, "id string, y string, tenure int")


def test_quotas_are_exact():
    plan = quotas({"No": 4000, "Yes": 1635}, DEFAULT_STEPS, "train")
    totals = {k: sum(v.values()) for k, v in plan.items()}
    n = 5635
    frozen = math.ceil(0.125 * n)
    test = math.ceil(0.125 / 0.875 * (n - frozen))
    val = math.ceil(0.15 / 0.75 * (n - frozen - test))
    assert totals == {"eval_frozen": frozen, "test": test, "val": val, "train": n - frozen - test - val}
    for counts in plan.values():
        assert counts["Yes"] / sum(counts.values()) == pytest.approx(1635 / n, abs=0.002)


def test_allot_keeps_the_total():
    assert allot(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    assert sum(allot(17, {"a": 90, "b": 7, "c": 3}).values()) == 17


def test_split_is_whole_exact_and_reproducible(people):
    excluded = F.col("tenure") >= 60
    split = stratified_split(people, "id", "y", excluded).toPandas().set_index("id").split
    assert len(split) == people.count() and split.index.is_unique
    src = people.toPandas().set_index("id")
    assert set(split[src.tenure >= 60]) == {"excluded"} and "excluded" not in set(split[src.tenure < 60])
    inside = src[src.tenure < 60]
    plan = quotas(inside.y.value_counts().to_dict(), DEFAULT_STEPS, "train")
    got = pd.crosstab(split[inside.index], inside.y)
    for name, counts in plan.items():
        for cls, n in counts.items():
            assert got.loc[name].get(cls, 0) == n, (name, cls)
    again = stratified_split(people.repartition(13), "id", "y", excluded).toPandas().set_index("id").split
    assert again.sort_index().equals(split.sort_index())
    other = stratified_split(people, "id", "y", excluded, seed=7).toPandas().set_index("id").split
    assert not other.sort_index().equals(split.sort_index())


def test_null_class_is_an_error(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "id string, y string")
    with pytest.raises(ValueError):
        stratified_split(df, "id", "y")


def test_summary(people):
    manifest = stratified_split(people, "id", "y")
    rows = {r.split: r for r in split_summary(manifest, people, "id", F.col("y") == "Yes").collect()}
    assert sum(r.n for r in rows.values()) == people.count()
    assert rows["train"].positive_pct == pytest.approx(rows["val"].positive_pct, abs=0.2)


def test_describe_matches_pandas(people):
    got = profile.grouped_describe(people, "y", ["tenure"]).toPandas().set_index("y")
    want = people.toPandas().groupby("y").tenure.describe()
    for cls in want.index:
        for ours, theirs in (("n", "count"), ("mean", "mean"), ("std", "std"), ("q25", "25%"), ("q75", "75%")):
            assert got.loc[cls, ours] == pytest.approx(want.loc[cls, theirs])


def test_segment_and_band_profiles(people):
    positive = F.col("y") == "Yes"
    rows = profile.segment_profile(people, F.col("tenure") >= 60, "late", positive).collect()
    assert sum(r.pct_of_total for r in rows) == pytest.approx(100)
    assert sum(r.pct_of_positives for r in rows) == pytest.approx(100)
    bands = profile.banded_profile(people, "tenure", [0, 18, 36], ["low", "mid"], positive).collect()
    assert {r.band for r in bands} == {"low", "mid"} and sum(r.pct_of_total for r in bands) < 60


def test_non_null_counts(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", None, None), ("b", 2, "x")], "g string, v int, w string")
    got = {r.g: (r.v, r.w) for r in profile.grouped_non_null_counts(df, "g").collect()}
    assert got == {"a": (1, 0), "b": (1, 1)}
    assert profile.rate_of(df, F.col("g") == "a").first().rate_pct == pytest.approx(200 / 3)


def test_many_classes_are_shared_out_in_a_table(spark, people):
    """50,000 classes and a hot one: quotas exact, and the table gives what the driver's way gives."""
    many = spark.range(150_000).selectExpr(
        "CAST(id AS STRING) AS id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 49999 AS STRING) END AS y"
    )
    table = stratified_split(many, "id", "y", driver_classes=100)
    assert table.exceptAll(stratified_split(many, "id", "y", driver_classes=100_000)).isEmpty()
    sizes = {r.y: r.n for r in many.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 50_000
    got = {(r.split, r.y): r.n for r in table.join(many, "id").groupBy("split", "y").agg(F.count("*").alias("n")).collect()}
    want = {(s, y): n for s, part in quotas(sizes, DEFAULT_STEPS, "train").items() for y, n in part.items() if n}
    assert got == want
    few = stratified_split(people, "id", "y", F.col("tenure") >= 60)
    assert stratified_split(people, "id", "y", F.col("tenure") >= 60, driver_classes=1).exceptAll(few).isEmpty()


def test_null_among_many_classes_is_an_error(spark):
    df = spark.range(50).selectExpr("id", "CASE WHEN id > 0 THEN CAST(id AS STRING) END AS y")
    with pytest.raises(ValueError):
        stratified_split(df, "id", "y", driver_classes=3)
