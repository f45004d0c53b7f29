"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from harness import catalog
from harness.compare import compare, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def database() -> duckdb.DuckDBPyConnection:
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, database, name):
    good, text = compare(spark, database, SMALL, name)
    assert good, text


def test_every_oracle_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert (rows[0].skill_name, rows[0].jobs) == ("Brand#13", 335)
