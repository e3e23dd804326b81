"""Every query with SQL gives in Spark what the SQL gives in DuckDB; the others give rows."""

import pytest

from lodestone.plans import registry
from tests.parity import compare, connect

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert compare(registry.queries()[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
