"""Every registered query with a DuckDB twin, on the smallest tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 25 and set(rows[0].asDict()) == {"country", "gross_sales", "orders", "share"}


def test_every_twin_has_a_query():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(spark, con, name):
    text, _, _ = differences(queries()[name](spark, SF), con, SQL[name])
    assert text == ""
