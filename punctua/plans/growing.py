"""Queries on order lines: the same operators on a unit table that grows with the input."""

from __future__ import annotations

from punctua.plans import units as u
from punctua.plans.oracle import LINE_UNITS, UNITS
from punctua.plans.registry import ORACLES, QUERIES, query

NAMES = [
    "d1_stratified_split", "d2_undersample", "d4_stratified_folds", "w1_rank_selection",
    "w2_rank_within_group", "w3_cumulative_curve", "e7_metric_table", "e8_bootstrap_intervals",
    "e9_calibration", "a9_exact_quantiles", "o3_five_policies", "o4_capacity_optimum",
    "o6_group_minimum", "o9_scenario_grid", "l1_test_hash",
]


def _per_line(function):
    def run(spark, sf):
        with u.per_line():
            return function(spark, sf)

    return run


for _name in NAMES:
    query(f"line_{_name}", ORACLES[_name].replace(UNITS, LINE_UNITS))(_per_line(QUERIES[_name]))
