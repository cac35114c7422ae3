"""Requests that the contract rejects are stored beside the facts, in batches and streams."""

import pytest

from modelwatch.suite import streams, training

SF = "/root/testdata/sf0.001"
SCHEMA = "customer_id bigint, n_chars bigint, lang string, source string"


@pytest.fixture(scope="module")
def result(spark):
    return training.train(training.labelled(spark, SF), "logreg")


@pytest.fixture(scope="module")
def requests(spark):
    good = [(i, 100 + i, "en", "web") for i in range(20)] + [(30, 7, "en", "web")] * 3
    bad = [(40, None, "en", "web"), (41, 0, "en", "web"), (42, 5, None, "web"), (43, 5, "en", None)]
    return spark.createDataFrame(good + bad, SCHEMA)


def agree(facts, rejected):
    assert facts.count() == 23 and facts.select("request_id").distinct().count() == 23
    rows = rejected.collect()
    assert sorted(r.customer_id for r in rows) == [40, 41, 42, 43] and all(r.errors for r in rows)


def test_batch(spark, result, requests):
    agree(*training.scored(spark, requests, result))


def test_stream_of_several_batches(spark, result, requests, tmp_path):
    requests.coalesce(1).write.option("maxRecordsPerFile", 9).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    agree(*streams.scored_stream(spark, stream, result))
