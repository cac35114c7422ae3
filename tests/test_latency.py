import datetime as dt

import pytest

from modelwatch.operators import latency, service

BOUNDS = [0.1, 0.2, 0.5, 1.0]


@pytest.fixture(scope="module")
def log(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(1, 201):
        ok = i % 10 != 0
        rows.append(
            (
                f"r{i}", "POST", "/predict" if i % 4 else "/healthz", 200 if ok else (422 if i % 20 else 500),
                float(i), i * 0.1, i * 0.5, i * 0.2 if i % 7 else None, t0 + dt.timedelta(minutes=i),
            )
        )
    return spark.createDataFrame(
        rows,
        "request_id string, method string, path string, status_code int, duration_ms double, routing_ms double, "
        "predict_ms double, insert_ms double, created_at timestamp_ntz",
    )


def hist(spark, cumulative):
    labels = [*[latency.bucket_label(b) for b in BOUNDS], "+Inf"]
    rows = [("/p", i, le, c) for i, (le, c) in enumerate(zip(labels, cumulative))]
    return spark.createDataFrame(rows, "path string, le_ord int, le string, cum bigint")


@pytest.mark.parametrize(
    "cumulative, q, want",
    [
        ([10, 20, 20, 20, 20], 0.75, 0.15),  # inside the second bucket, from its lower bound
        ([10, 20, 20, 20, 20], 0.25, 0.05),  # first bucket starts at zero
        ([10, 20, 30, 40, 80], 0.9, 1.0),  # open-ended bucket: last finite bound
        ([0, 0, 4, 4, 4], 0.5, 0.35),  # empty buckets are skipped
        ([0, 0, 0, 0, 0], 0.5, None),
    ],
)
def test_histogram_quantile(spark, cumulative, q, want):
    got = latency.histogram_quantile(hist(spark, cumulative), {"q": q}, ["path"], BOUNDS).first().q
    assert got == (None if want is None else pytest.approx(want))


def test_merge_equals_histogram_of_the_union(log):
    whole = latency.latency_histogram(log).collect()
    half = [latency.latency_histogram(log.filter(f"duration_ms % 2 = {i}")) for i in (0, 1)]
    merged = latency.merge_histograms(half[0].unionByName(half[1])).collect()
    assert sorted(whole) == sorted(merged)


def test_histogram_is_cumulative_and_complete(log):
    rows = latency.latency_histogram(log).filter("path = '/predict'").orderBy("le_ord").collect()
    counts = [r.cum for r in rows]
    assert counts == sorted(counts) and rows[-1].le == "+Inf" and counts[-1] == 150


def test_phases_come_in_processing_order(log):
    assert [r.phase for r in latency.phase_percentiles(log).collect()] == ["routing", "predict", "insert", "total"]


def test_composition_shares_add_up(log):
    for r in latency.composition(log).collect():
        assert r.routing_pct + r.predict_pct + r.insert_pct + r.other_pct == pytest.approx(100, abs=0.2)


def test_quantile_error(log):
    rows = {r.quantile: r for r in latency.quantile_error(log).collect()}
    assert set(rows) == {"p50", "p95", "p99"}
    assert rows["p95"].error == pytest.approx(rows["p95"].estimated - rows["p95"].exact)


def test_running_over_buckets(spark):
    df = spark.createDataFrame([("/p", 0, 3), ("/p", 1, 2), ("/p", 2, 0)], "path string, le_ord int, cnt int")
    got = latency.running_over_buckets(df).orderBy("le_ord").collect()
    assert [r.cum for r in got] == [3, 5, 5]


def test_rates_and_errors(log):
    rates = service.request_rate(log, 3600).collect()
    assert sum(r.per_second for r in rates) * 3600 == pytest.approx(200)
    errors = service.error_ratio(log, 10**6).collect()
    assert len(errors) == 1
    assert (errors[0].client_error_ratio, errors[0].server_error_ratio) == (0.05, 0.05)
    assert service.request_counts(log).count() == 4


def test_latency_over_time_uses_bucket_counts_only(log, capsys):
    series = service.latency_over_time(log, 3600, {"p50": 0.5})
    assert series.count() == 4
    series.explain("formatted")
    assert "percentile" not in capsys.readouterr().out
