"""The storage queries compare and return all days and columns."""

import pytest
from pyspark.sql import functions as F

from modelwatch.operators.checks import CheckFailed
from modelwatch.suite import storage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("doubled", [False, True])
def test_facts_of_other_days(spark, monkeypatch, doubled):
    append = storage.sinks.append_predictions
    other = F.to_date("event_time") > F.lit("2024-01-20").cast("date")

    def broken(facts, path):
        append(facts if doubled else facts.filter(~other), path)
        if doubled:
            rows = facts.filter(other).withColumn("event_date", F.to_date("event_time")).limit(1)
            rows.write.mode("append").partitionBy("event_date").parquet(path)

    assert storage.predictions(spark, SF).filter(other).count()
    assert storage.QUERIES["stored_predictions"](spark, SF).count()
    monkeypatch.setattr(storage.sinks, "append_predictions", broken)
    with pytest.raises(CheckFailed):
        storage.QUERIES["stored_predictions"](spark, SF)


def test_all_customer_columns(spark, monkeypatch):
    assert storage.QUERIES["dataset_csv"](spark, SF).count()
    assert set(storage.CUSTOMER_CSV.names) == set(storage.files.table(spark, SF, "customer").columns)
    read = storage.files.read_csv
    monkeypatch.setattr(storage.files, "read_csv", lambda *a: read(*a).withColumn("c_nationkey", F.lit(0).cast("bigint")))
    with pytest.raises(CheckFailed):
        storage.QUERIES["dataset_csv"](spark, SF)
