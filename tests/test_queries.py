"""Every registered query against its SQL twin, on the smallest tables."""

import sys
from pathlib import Path

import pytest
from parity import difference, oracle_connection

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs_without_sql(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [(r.feature, r.window_days, r.day_index) for r in rows] == [("value", 7, 24)]
    assert rows[0].false_alarms == 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
