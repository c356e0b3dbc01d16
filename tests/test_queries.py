"""Registered queries against their SQL, on the smallest tables.

``python tests/oracle.py`` checks all of them at sf0.01.
"""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
PICKED = ["a1_dataset_summary", "d2_undersample", "f4_scaled", "m7_gaussian_nb",
          "e7_metric_table", "o6_group_minimum", "o9_scenario_grid", "l1_test_hash"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, con, name):
    ok, message = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 7
