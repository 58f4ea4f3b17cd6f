"""Every registered query with SQL must equal it on the smallest tables."""

import os

import pytest
from conftest import SF_DIR
from oracle_check import connect, difference

import __spark_entry__ as entry

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables absent")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF_DIR), con, SQL[name]) is None


@pytest.mark.parametrize("name", ["rubric_metrics", "decile_lift", "calibration_bins", "threshold_table", "equity_table"])
def test_equals_sql_in_buckets(spark, con, name, many_buckets):
    assert difference(entry.queries()[name](spark, SF_DIR), con, SQL[name]) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.subgroup for r in rows} == {"Glaucoma only", "Diabetic only", "Glaucoma+Diabetic"}
    assert [r.prevalence for r in rows] == sorted((r.prevalence for r in rows), reverse=True)


def test_registry_is_consistent():
    assert set(SQL) <= set(entry.queries())
