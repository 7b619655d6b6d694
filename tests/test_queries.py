"""Every query with SQL against DuckDB on the smallest tables; the contract functions."""

import os

import pytest

import __spark_entry__ as entry
from checks import CHECKS, SQL
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, con, name):
    line = compare(spark, con, SF, name)
    assert line.startswith("ok") and "TYPES" not in line, line


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    rows_only = set(CHECKS) - set(SQL)
    assert all(n.startswith(("gbt_", "forest_", "grid_score", "branch_")) for n in rows_only), rows_only
