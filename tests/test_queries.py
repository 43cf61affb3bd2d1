"""Registered queries against DuckDB on the smallest tables, and the entry point."""

import pytest

import __spark_entry__
from newsdesk.plans.catalog import LATEST, ORACLES, QUERIES
from tests.compare import connect, same_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    same_rows(QUERIES[name](spark, FOLDER), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == QUERIES[LATEST](spark, FOLDER).columns
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_subpackage(monkeypatch):
    monkeypatch.setattr(__spark_entry__, "_present", lambda name: False)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLES)
