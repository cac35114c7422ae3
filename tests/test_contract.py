import json

import pytest
from pyspark.sql import functions as F

from modelwatch.operators.contract import TELCO_CONTRACT, parse_records, split_valid, validate, violations

#: Built from the contract: the last allowed value of each choice, the same number elsewhere.
VALID = {
    rule.name: rule.domain[-1] if rule.domain else "k-31" if rule.kind == "string" else 3
    for rule in TELCO_CONTRACT.fields
    if not rule.optional
}
NOW = "2023-11-20 08:00:00"
CHOICES = [rule.name for rule in TELCO_CONTRACT.fields if rule.domain and rule.kind == "string"]
NUMBERS = [rule.name for rule in TELCO_CONTRACT.fields if rule.minimum is not None]

#: (what is changed, which fields are to be named); an ellipsis takes the key away.
CASES = [({}, [])]
CASES += [({name: "some other level"}, [name]) for name in CHOICES]
CASES += [({name: -4}, [name]) for name in NUMBERS]
CASES += [({name: "many"}, [name]) for name in NUMBERS]
CASES += [({rule.name: ...}, [rule.name]) for rule in TELCO_CONTRACT.fields if not rule.optional]
CASES += [
    ({"tenure": 3.25}, ["tenure"]),
    ({"SeniorCitizen": 9}, ["SeniorCitizen"]),
    ({"SeniorCitizen": "1"}, ["SeniorCitizen"]),
    ({"customer_id": 31}, ["customer_id"]),
    ({CHOICES[0]: None, CHOICES[1]: 5}, CHOICES[:2]),
    ({"TotalCharges": None}, ["TotalCharges"]),
    ({"TotalCharges": None, "tenure": 0}, []),
    ({"event_time": None}, []),
    ({"event_time": "2023-11-20T07:59:00Z"}, []),
    ({"event_time": "2023-11-20T10:30:00+02:30"}, []),
    ({"event_time": "2023-11-21T08:00:00Z"}, ["event_time"]),
    ({"event_time": "2023-11-20T08:00:00"}, ["event_time"]),
]


def record(change):
    body = {**VALID, **change}
    return json.dumps({k: v for k, v in body.items() if v is not ...})


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(i, record(c)) for i, (c, _) in enumerate(CASES)] + [(len(CASES), "{not json")]
    df = spark.createDataFrame(rows, "i int, value string")
    parsed = parse_records(df, "value", TELCO_CONTRACT, keep=["i"])
    return validate(parsed, TELCO_CONTRACT, now=F.lit(NOW).cast("timestamp"))


def test_every_case_names_its_fields(checked):
    got = {r.i: sorted(r.errors) for r in checked.select("i", "errors").collect()}
    for i, (change, errors) in enumerate(CASES):
        assert got[i] == sorted(errors), change
    assert got[len(CASES)] == ["_record"]


def test_nothing_is_lost(checked):
    valid, quarantine = split_valid(checked)
    assert valid.count() == sum(not e for _, e in CASES)
    assert valid.count() + quarantine.count() == len(CASES) + 1
    assert "errors" not in valid.columns and "_raw" in quarantine.columns


def test_typed_values(checked):
    row = checked.filter("i = 0").first()
    assert (row.tenure, row.MonthlyCharges, row.TotalCharges, row.customer_id) == (3, 3.0, 3.0, "k-31")


def test_violations_count_records(checked):
    counts = {r.field: r.n_records for r in violations(checked).collect()}
    assert counts["TotalCharges"] == sum("TotalCharges" in e for _, e in CASES) and counts["_record"] == 1


def test_no_shuffle(checked, capsys):
    checked.explain("formatted")
    assert "Exchange" not in capsys.readouterr().out
