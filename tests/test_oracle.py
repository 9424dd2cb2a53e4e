"""Every registered query with a SQL counterpart returns the same rows."""

import pytest

import __spark_entry__ as entry
from comparing import connect, difference, spark_result, sql_result

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_counterpart_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    ours = spark_result(entry.queries()[name](spark, SF_DIR))
    assert not difference(ours, sql_result(con, entry.oracle_sql()[name]))


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10
