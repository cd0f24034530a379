"""Every query that SQL can answer, against DuckDB on the whole tables."""

import pytest
from compare import TESTDATA, differences, duck

import __spark_entry__ as entry

SF = "sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, str(TESTDATA / SF))
    assert differences(df, con, entry.oracle_sql()[name]) == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
