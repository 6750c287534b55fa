"""Every registered query with SQL gives the rows DuckDB gives."""

import pytest

from checks.compare import compare, duck
from checks.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, sf, name):
    assert compare(spark, db, QUERIES[name], SQL[name], sf) == ""


def test_names_and_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
