import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import alerts, drift

LEVELS = ["a", "b", "c"]


def frame(spark, pdf):
    return spark.createDataFrame(
        [tuple(None if pd.isna(v) else v for v in r) for r in pdf.astype(object).values],
        "day date, x double, n double, cat string",
    )


def sample(seed, days, rows, shift=0.0):
    rng = np.random.default_rng(seed)
    out = []
    for d in days:
        for _ in range(rows):
            x = float(np.round(rng.normal(shift), 1)) if rng.random() > 0.05 else None
            out.append((d, x, float(rng.integers(0, 4)), rng.choice(["a", "b", "zz", None], p=[0.5, 0.3, 0.1, 0.1])))
    return pd.DataFrame(out, columns=["day", "x", "n", "cat"])


def pandas_edges(values):
    _, edges = pd.qcut(values.dropna(), 10, retbins=True, duplicates="drop")
    return edges


def pandas_psi(ref, cur, feature, edges=None):
    if edges is not None:
        open_edges = [-np.inf, *edges[1:-1], np.inf]

        def shares(v):
            counts = pd.cut(v, open_edges).value_counts(sort=False).tolist() + [v.isna().sum()]
            return np.array(counts) / len(v)
    else:

        def shares(v):
            return v.value_counts(normalize=True).reindex(LEVELS, fill_value=0).to_numpy()

    p = np.maximum(shares(ref[feature]), 1 / (2 * len(ref)))
    q = np.maximum(shares(cur[feature]), 1 / (2 * len(cur)))
    return float(np.sum((q - p) * np.log(q / p)))


@pytest.fixture(scope="module")
def data():
    ref = sample(1, [dt.date(2024, 1, 1)], 800)
    first = dt.date(2024, 2, 1)
    days = [first + dt.timedelta(days=i) for i in (0, 1, 2, 3, 4, 8, 9, 15)]
    return ref, sample(2, days, 60, 0.4)


def fitted(spark, ref):
    return drift.fit_reference(frame(spark, ref), ["x", "n"], {"cat": LEVELS})


def test_edges_match_qcut(spark, data):
    ref, _ = data
    got = {r.feature: r.edges for r in drift.fit_bin_edges(frame(spark, ref), ["x", "n"]).collect()}
    for f in ("x", "n"):
        assert got[f] == pytest.approx(pandas_edges(ref[f]).tolist(), abs=1e-12)


def test_rolling_psi_matches_pandas(spark, data):
    ref, cur = data
    reference = fitted(spark, ref)
    got = drift.drift_metrics(frame(spark, cur).repartition(5), reference, (1, 7)).toPandas()
    edges = {f: pandas_edges(ref[f]) for f in ("x", "n")}
    days = sorted(cur.day.unique())
    expected = {}
    for w in (1, 7):
        for end in days:
            if end < days[0] + dt.timedelta(days=w - 1):
                continue
            part = cur[(cur.day > end - dt.timedelta(days=w)) & (cur.day <= end)]
            for f in ("x", "n", "cat"):
                expected[(end, f, w)] = (pandas_psi(ref, part, f, edges.get(f)), len(part))
    assert len(got) == len(expected)
    for _, r in got.iterrows():
        psi, n = expected[(r.day, r.feature, r.window_days)]
        assert r.psi == pytest.approx(psi, abs=1e-12) and r.n_rows == n


def test_window_gap(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 9)]
    ref, cur = sample(1, [days[0]], 100), sample(4, days, 10)
    got = drift.drift_metrics(frame(spark, cur), fitted(spark, ref), (7,)).toPandas()
    assert set(got.day) == {dt.date(2024, 1, 9)} and set(got.n_rows) == {10}


def test_psi_of_itself_is_zero(spark, data):
    ref, _ = data
    got = drift.psi_between(frame(spark, ref), fitted(spark, ref)).toPandas()
    assert len(got) == 3 and got.psi.abs().max() == 0.0


def test_psi_is_symmetric_for_equal_sizes(spark):
    day = [dt.date(2024, 1, 1)]
    a, b = sample(1, day, 400), sample(2, day, 400, 0.5)
    domains = {"cat": LEVELS}
    one = drift.psi_between(frame(spark, b), drift.fit_reference(frame(spark, a), [], domains)).first()
    two = drift.psi_between(frame(spark, a), drift.fit_reference(frame(spark, b), [], domains)).first()
    assert one.psi == pytest.approx(two.psi, abs=1e-12)


def test_constant_column_is_one_bin(spark):
    df = spark.createDataFrame([(7.0,), (7.0,), (None,), (float("nan"),)], "c double")
    reference = drift.fit_reference(df, ["c"], {})
    assert reference.numeric == {"c": []}
    shares = {r.bin: r.share for r in drift.numeric_shares(df, reference.numeric).collect()}
    assert shares == {0: 0.5, drift.MISSING: 0.5}


def test_categorical_shares_keep_unknown_in_the_denominator(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,), ("a",)], "c string")
    shares = {r.bin: r.share for r in drift.categorical_shares(df, {"c": ["a", "b"]}).collect()}
    assert shares == {0: pytest.approx(2 / 3), 1: 0.0}


def test_reference_survives_json(spark, data):
    reference = fitted(spark, data[0])
    assert drift.DriftReference.from_json(reference.to_json()) == reference


def test_traffic_is_read_once(spark, data, tmp_path, capsys):
    ref, cur = data
    frame(spark, cur).write.parquet(str(tmp_path / "t"))
    traffic = spark.read.parquet(str(tmp_path / "t"))
    drift.drift_metrics(traffic, fitted(spark, ref)).explain("formatted")
    assert capsys.readouterr().out.count("ReadSchema") == 1


def metrics(spark, series):
    rows = [
        (dt.date(2024, 1, 1) + dt.timedelta(days=i), f, 1, float(v), 50)
        for f, values in series.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "day date, feature string, window_days int, psi double, n_rows bigint")


def test_detection(spark):
    quiet = [0.01 * (i % 5) for i in range(20)]  # p50 0.02, p95 0.04: line 0.08
    m = metrics(spark, {"calm": quiet + [0.02] * 10, "moved": quiet + [0.05, 0.08, 0.3] + [0.5] * 7,
                        "early": [0.5] + quiet[1:] + [0.02] * 10})
    got = {r.feature: r for r in alerts.detections(m).collect()}
    assert set(got) == {"moved", "early"}
    assert got["moved"].day_index == 21 and got["moved"].false_alarms == 0
    assert got["early"].day_index == 0 and got["early"].false_alarms == 1
    lines = {r.feature: r.alert_at for r in alerts.alert_lines(m).collect()}
    assert lines["moved"] == pytest.approx(0.08)


def test_noise_floor_order_and_separation(spark):
    m = metrics(spark, {"flat": [0.0] * 20 + [0.1] * 5, "up": [0.1] * 20 + [0.4] * 5})
    rows = alerts.noise_floor(m).collect()
    assert [r.feature for r in rows] == ["up", "flat"]
    assert rows[0].separation == 4.0 and rows[1].separation is None


def test_agreement_counts_up(spark):
    quiet = [0.01 * (i % 5) for i in range(20)]
    m = metrics(spark, {"a": quiet + [0.0, 0.5], "b": quiet + [0.0, 0.5], "c": quiet + [0.9, 0.9], "d": quiet + [0.0] * 2})
    rows = alerts.agreement(alerts.detections(m)).orderBy("alert_day").collect()
    assert [(r.n_new, r.n_crossed) for r in rows] == [(1, 1), (2, 3)]


def test_flat_quiet_period_alarms_on_itself(spark):
    """With p50 = p95 the line is the quiet level, and reaching it counts as crossing."""
    m = metrics(spark, {"flat": [0.01] * 25})
    assert alerts.detections(m).first().false_alarms == 20


def test_daily_share(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), 1), (dt.datetime(2024, 1, 1, 6), 0)], "t timestamp_ntz, v int")
    assert alerts.daily_share(df, "t", F.col("v") == 1).first().shifted_share == 0.5
