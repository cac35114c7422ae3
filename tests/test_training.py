import datetime as dt
import json

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from telco import raw_frame

from modelwatch.functions.columns import blank_to_null
from modelwatch.operators.checks import CheckFailed
from modelwatch.operators.contract import TELCO_CONTRACT, parse_records
from modelwatch.operators.drift import DriftReference
from modelwatch.operators.features import FEATURES, balanced_weights, fit, standardise
from modelwatch.operators.scoring import predict_scores, responses, score_foreign, score_requests
from modelwatch.operators.splits import stratified_split
from modelwatch.plans import monitoring, training
from modelwatch.schemas import (
    TELCO,
    TELCO_MONITORED_CATEGORICAL,
    TELCO_MONITORED_NUMERIC,
    FeatureSet,
)
from modelwatch.sinks import tables as sinks
from modelwatch.sources import files



def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("telco")
    raw_frame(spark).coalesce(1).write.option("header", True).option("emptyValue", "").csv(str(folder / "raw"))
    raw = files.read_dataset(spark, str(folder / "raw"))
    manifest = stratified_split(raw, "customerID", "Churn", F.col("tenure") >= 60)
    sinks.write_manifest(manifest, str(folder / "manifest"))
    data = files.load_dataset(raw, files.read_manifest(spark, str(folder / "manifest")))
    data.write.parquet(str(folder / "data"))
    return spark.read.parquet(str(folder / "data"))


@pytest.fixture(scope="module")
def trained(dataset):
    return training.run_training(dataset, TELCO, "logreg", True, min_precision=0.55)


def test_metrics_make_sense(trained):
    m = trained.metrics
    assert m["pr_auc"] > m["prevalence"] + 0.1 and m["precision"] >= 0.55 and 0 < m["threshold"] < 1
    assert trained.sample.count() == 50


def test_logistic_regression_reaches_the_penalised_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] + 0.3)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    model = fit("logreg", df, FeatureSet(["a", "b"], {}), scale_numeric=True)
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(400)]
    w = np.zeros(3)
    penalty = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):  # Newton steps on sum of log losses + |w|^2 / 2, intercept free
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    lr = model.stages[-1]
    assert [*lr.coefficients, lr.intercept] == pytest.approx(w.tolist(), abs=1e-4)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(0,)] * 8, "label int")
    weights = {r.label: r.class_weight for r in balanced_weights(df).distinct().collect()}
    assert weights == {0: 0.625, 1: 2.5}


def test_population_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    rows = standardise(df, ["a", "c"]).orderBy("a").collect()
    assert rows[0].a_scaled == pytest.approx(-1 / np.sqrt(2 / 3)) and {r.c_scaled for r in rows} == {0.0}


def test_unknown_level_is_all_zeros(spark, dataset, trained):
    row = dataset.filter("split = 'val'").orderBy("customerID").limit(1)
    odd = row.withColumn("Contract", F.lit("Three year"))
    sizes = []
    for frame in (row, odd):
        features = trained.model.transform(frame).select(vector_to_array(FEATURES).alias("f")).first().f
        sizes.append(sum(1 for v in features if v == 1.0))
    assert sizes[0] - sizes[1] == 1


def scores(model, frame):
    return {r.customerID: r.score for r in predict_scores(model, frame).select("customerID", "score").collect()}


def test_one_path_to_the_score(spark, dataset, trained):
    """Single rows, rebuilt records and shuffled columns score exactly as the batch does."""
    val = dataset.filter("split = 'val'").select("customerID", *TELCO.all)
    batch = scores(trained.model, val)
    for row in val.orderBy("customerID").limit(5).collect():
        single = spark.createDataFrame([row], val.schema)
        assert scores(trained.model, single)[row.customerID] == pytest.approx(batch[row.customerID], abs=1e-12)
    shuffled = val.select(*reversed(TELCO.all), "customerID")
    assert scores(trained.model, shuffled) == pytest.approx(batch, abs=1e-12)


def test_saved_model_reproduces_the_sample(spark, dataset, trained, tmp_path):
    folder, runs = str(tmp_path / "m1"), str(tmp_path / "runs")
    training.log_run(trained, "logreg_scaled", folder, runs)
    model, version, threshold = files.load_model(spark, folder)
    assert version == "logreg_scaled" and threshold == trained.metrics["threshold"]
    sample = files.read_verification_sample(spark, f"{folder}/verification_sample")
    training.verify_model(model, sample)
    off = sample.withColumn("expected_score", F.col("expected_score") + F.lit(2e-9))
    with pytest.raises(CheckFailed, match="50 rows differ"):
        training.verify_model(model, off)
    near = sample.withColumn("expected_score", F.col("expected_score") + F.lit(5e-10))
    training.verify_model(model, near)
    training.promote(spark, str(tmp_path / "champion"), folder)
    assert files.load_champion(spark, str(tmp_path / "champion"))[1:] == (version, threshold)
    assert training.gate_champion(spark, str(tmp_path / "champion"), dataset, TELCO, 0.2).first().passed
    with pytest.raises(CheckFailed, match="is below"):
        training.gate_champion(spark, str(tmp_path / "champion"), dataset, TELCO, 1.1)
    sinks.save_model(model, str(tmp_path / "m2"), "2", threshold)
    sinks.write_verification_sample(off, str(tmp_path / "m2/verification_sample"))
    with pytest.raises(CheckFailed, match="50 rows differ"):
        training.promote(spark, str(tmp_path / "champion"), str(tmp_path / "m2"))
    assert spark.read.json(str(tmp_path / "champion")).first().model_path == folder
    sinks.append_training_run(spark, {"run_name": "worse", "pr_auc": 0.1}, runs)
    assert [r.run_name for r in training.compare_runs(spark.read.parquet(runs)).collect()] == ["logreg_scaled", "worse"]


def test_other_estimators(dataset):
    for name, scale, iters in (("logreg_balanced", True, 50), ("gb", False, 5)):
        r = training.run_training(dataset, TELCO, name, scale, min_precision=0.4, max_iter=iters)
        assert r.metrics["pr_auc"] > r.metrics["prevalence"]
    with pytest.raises(ValueError):
        training.run_training(dataset, TELCO, "forest")


def test_gate_and_bootstrap(dataset, trained):
    row = training.run_gate(trained.model, dataset, TELCO, trained.metrics["threshold"], minimum=0.2).first()
    assert row.passed and row.margin == pytest.approx(row.value - 0.2) and 0 < row.recall <= 1
    band = training.run_bootstrap(trained.model, dataset, TELCO, 100).first()
    assert band.p2_5 < row.value < band.p97_5


def test_score_job_and_drift_job(spark, dataset, trained, tmp_path):
    """Records in, facts out, drift measured on what was stored."""
    days = 9
    body = dataset.filter("split in ('test', 'eval_frozen')").withColumn(
        "event_time",
        F.date_format(
            F.lit(dt.datetime(2024, 2, 1)) + F.make_dt_interval((F.abs(F.xxhash64("customerID")) % days).cast("int")),
            "yyyy-MM-dd'T'HH:mm:ssXXX",
        ),
    )
    record = F.to_json(
        F.struct(
            F.col("customerID").alias("customer_id"), "event_time",
            *[F.col(c) for c in TELCO.all if c != "TotalCharges"],
            blank_to_null("TotalCharges").alias("TotalCharges"),
        ),
        {"ignoreNullFields": "false"},
    )
    raw = body.select(record.alias("value")).union(spark.createDataFrame([('{"customer_id": 1}',)], "value string"))
    raw.write.text(str(tmp_path / "requests"))
    requests = files.read_requests(spark, str(tmp_path / "requests"))
    facts_path, bad_path = str(tmp_path / "predictions"), str(tmp_path / "quarantine")
    monitoring.score_job(requests, trained.model, 0.4, "3", TELCO_CONTRACT, facts_path, bad_path, now())
    facts = spark.read.parquet(facts_path)
    assert facts.count() == body.count() and spark.read.parquet(bad_path).count() == 1
    assert facts.select("request_id").distinct().count() == facts.count()
    expected = scores(trained.model, body)
    for r in responses(facts).collect():
        assert r.probability == pytest.approx(expected[r.customer_id], abs=1e-9)
        assert r.prediction == ("churn" if r.probability >= 0.4 else "no_churn") and r.model_version == 3

    reference = monitoring.reference_from_split(
        dataset, trained.model, TELCO, TELCO_MONITORED_NUMERIC, TELCO_MONITORED_CATEGORICAL
    )
    assert isinstance(reference, DriftReference) and len(reference.features) == 20
    metrics = monitoring.drift_job(facts, reference, "3", str(tmp_path / "drift"))
    assert metrics.count() == 20 * (days + days - 6)
    assert monitoring.drift_job(facts, reference, "3", str(tmp_path / "drift")).count() == metrics.count()
    with pytest.raises(CheckFailed):
        monitoring.drift_job(facts, reference, "4", str(tmp_path / "drift"))
    floor, found = monitoring.alert_report(metrics, facts, F.col("tenure") >= 60, quiet_days=8)
    assert floor.count() == 40 and "shifted_pct_that_day" in found.columns

    outcomes = facts.filter("probability > 0.6").select("request_id", (F.col("event_time") + F.expr("interval 5 days")).alias("outcome_at"))
    labels = monitoring.label_job(facts, outcomes, str(tmp_path / "labels"))
    assert labels.count() == facts.count() and labels.filter("label = 1").count() == outcomes.count()
    truth = monitoring.truth_job(facts, dataset)
    assert truth.count() == facts.count()


def test_default_time_and_given_ids(spark, dataset, trained):
    body = dataset.limit(3).select(F.col("customerID").alias("customer_id"), *TELCO.all).withColumn(
        "TotalCharges", blank_to_null("TotalCharges")
    ).withColumn("request_id", F.lit("given"))
    facts, _ = score_requests(body, trained.model, 0.5, "1", TELCO_CONTRACT, now=now())
    rows = facts.collect()
    assert {r.request_id for r in rows} == {"given"}
    assert {r.event_time for r in rows} == {r.created_at for r in rows}


def test_foreign_model(spark):
    df = spark.createDataFrame([(1.0, 2.0, "k"), (3.0, 4.0, "l")], "a double, b double, id string")
    got = score_foreign(df, lambda x: x["b"] - x["a"] * 2, ["b", "a"]).orderBy("id").collect()
    assert [r.score for r in got] == [0.0, -2.0]


def test_requests_survive_json_round_trip(spark):
    text = json.dumps({"customer_id": "x"})
    parsed = parse_records(spark.createDataFrame([(text,)], "value string"), "value", TELCO_CONTRACT)
    assert "tenure" in parsed.first()._malformed


def test_missing_csv_is_a_clear_error(spark, tmp_path):
    with pytest.raises(RuntimeError, match="could not read the dataset"):
        files.read_dataset(spark, str(tmp_path / "none"))
