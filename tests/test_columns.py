import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modelwatch.functions import columns as fx


def values(df, name):
    return [r[name] for r in df.collect()]


def test_text_to_number(spark):
    texts = ["7", " 7 ", "1e3", "-2.5", "", "  ", "1d", "2f", "abc", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    expected = [7.0, 7.0, 1000.0, -2.5, None, None, None, None, None, None]
    assert values(df.select(fx.number_or_null("t").alias("x")), "x") == expected
    assert values(df.select(fx.number_or_zero("t").alias("x")), "x") == [e or 0.0 for e in expected]


def test_blank_is_null(spark):
    df = spark.createDataFrame([("",), ("  ",), ("660.5",), (None,)], "t string")
    assert values(df.select(fx.blank_to_null("t").alias("x")), "x") == [None, None, 660.5, None]


def test_bands_include_lowest(spark):
    df = spark.createDataFrame([(v,) for v in (0, 18, 36, 60, 72, 73, -1)], "v int")
    got = values(df.select(fx.band("v", [0, 18, 36, 60, 72], ["1", "1b", "2", "3"]).alias("b")), "b")
    cut = pd.cut(
        pd.Series([0, 18, 36, 60, 72, 73, -1]), [0, 18, 36, 60, 72], labels=["1", "1b", "2", "3"], include_lowest=True
    )
    assert got == [None if pd.isna(c) else c for c in cut]


def test_right_closed_bins_match_cut(spark):
    rng = np.random.default_rng(1)
    sample = np.round(rng.normal(size=500), 1)
    edges = [-1.0, -0.3, 0.0, 0.5, 1.2]
    df = spark.createDataFrame([(float(v),) for v in sample], "v double")
    got = values(df.select(F.expr(fx.right_closed_bin("v", edges)).alias("b")), "b")
    want = pd.cut(pd.Series(sample), [-np.inf, *edges, np.inf], labels=False)
    assert got == want.tolist()


def test_missing_is_null_or_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert values(df.select(fx.is_missing("v").alias("m")), "m") == [False, True, True]


def test_dates(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-14 23:59:59' AS a, timestamp_ntz'2024-01-15 12:00:00' AS b, 3 AS n"
    )
    row = df.select(
        fx.week_of("a").cast("string").alias("wa"),
        fx.week_of("b").cast("string").alias("wb"),
        fx.whole_days(F.to_date("b"), F.to_date("a")).alias("d"),
        fx.fractional_days("b", "a").alias("f"),
        fx.plus_days("a", "n").cast("string").alias("p"),
    ).first()
    assert (row.wa, row.wb, row.d) == ("2024-01-08", "2024-01-15", 1)
    assert row.f == pytest.approx((12 * 3600 + 1) / 86400)
    assert row.p == "2024-01-17 23:59:59"


def test_ratio_by_zero_is_null_and_decision_is_inclusive(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 4, 0.49)], "a int, b int, s double")
    rows = df.select(fx.ratio("a", "b").alias("r"), fx.decide("s", F.lit(0.5), "yes", "no").alias("d")).collect()
    assert [(r.r, r.d) for r in rows] == [(None, "yes"), (0.25, "no")]


def test_default_id_is_reproducible(spark):
    df = spark.createDataFrame([(None, "x"), ("given", "x")], "request_id string, v string")
    ids = values(df.select(fx.default_id("request_id", ["v"]).alias("i")), "i")
    again = values(df.repartition(4).select(fx.default_id("request_id", ["v"]).alias("i")), "i")
    assert sorted(ids) == sorted(again) and "given" in ids and len(ids[0]) == 64


def test_unmapped_value_is_null(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("Maybe",)], "v string")
    assert values(df.select(fx.map_values("v", {"Yes": 1, "No": 0}).alias("m")), "m") == [1, 0, None]
