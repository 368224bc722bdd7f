"""Every query with SQL against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from checks.compare import connect, differences
from checks.oracle import ORACLE_SQL
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(entry_module.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_analysis_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(NAMES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    assert differences(df, duck.sql(entry_module.oracle_sql()[name])) == []


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
