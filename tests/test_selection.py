import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctua.operators import order, selection


def frame(spark, values, risks, groups=None, mandatory=()):
    rows = [(i, float(v), float(p), i % 2, (groups or "A" * len(values))[i], i in mandatory)
            for i, (v, p) in enumerate(zip(values, risks))]
    return spark.createDataFrame(
        rows, "unit_id long, value double, probability double, target int, carrier string, "
              "mandatory boolean")


def taken(df):
    return {r.unit_id for r in df.where("selected").collect()}


def test_capacity_only_equals_net_score(spark):
    df = frame(spark, [5000, 4500, 4000, 3500, 3000, 2500], [.8, .1, .6, .2, .5, .1])
    best = taken(selection.capacity_optimum(df, 2000, 0.5))
    marked = selection.policies(df, 2000, 0.5, "r")
    assert best == taken(marked.where("strategy = 'net_score'")) and len(best) == 3
    sizes = marked.where("selected").groupBy("strategy").count().collect()
    assert {r.strategy: r["count"] for r in sizes} == {s: 3 for s in selection.POLICIES}


def test_negative_net_is_left_out_of_the_optimum_only(spark):
    df = frame(spark, [10, 10], [.9, .1])
    assert taken(selection.capacity_optimum(df, 20, 1.0)) == {1}
    ranked = selection.policies(df, 20, 1.0, "r").where("strategy = 'net_score'")
    assert taken(ranked) == {0, 1}


def test_tie_order(spark):
    df = spark.createDataFrame(list(enumerate([5.0, 5.0, 5.0, 1.0])), "unit_id long, s double")
    quota = spark.createDataFrame([(4, 2)], "n long, k long")
    assert taken(order.top_k(df, "s", "unit_id", quota)) == {2, 1}
    assert taken(order.top_k(df, "s", "unit_id", quota, ascending=True)) == {3, 0}


def test_group_minimum_fixture(spark):
    df = frame(spark, [3000] * 9, np.linspace(.05, .95, 9), "AAAABBBBB", {8})
    got = taken(selection.structural_optimum(df, 2000, 0.6, "carrier", 0.4))
    assert 8 in got and len(got) <= 5
    assert len(got & {0, 1, 2, 3}) >= 2 and len(got & {4, 5, 6, 7, 8}) >= 2


def test_infeasible_and_argument_errors(spark):
    df = frame(spark, [1, 1, 1, 1], [.1] * 4, "AABB")
    with pytest.raises(RuntimeError, match="Infeasible"):
        selection.structural_optimum(df, 1, 0.5, "carrier", 1.0)
    crowded = frame(spark, [1, 1, 1, 1], [.1] * 4, "AABB", {0, 1, 2})
    with pytest.raises(ValueError, match="Mandatory"):
        selection.structural_optimum(crowded, 1, 0.5, "carrier", 0.0)
    with pytest.raises(ValueError):
        selection.structural_optimum(df, 1, 0.5, "carrier", 1.5)
    with pytest.raises(ValueError):
        selection.capacity_count(4, 0.0)
    with pytest.raises(ValueError):
        selection.commercial_values(df, 2, 1, "v")
    with pytest.raises(ValueError, match="outside"):
        selection.require_known(df, spark.createDataFrame([(9,)], "unit_id long"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_group_minimum_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 9
    values, risks = rng.integers(0, 8, n), rng.integers(0, 5, n) / 4
    groups = "".join(rng.choice(list("ABC"), n))
    forced = {int(rng.integers(0, n))}
    net = values - 6 * risks
    cap = math.floor(n * 0.8)
    best = None
    for bits in itertools.product([0, 1], repeat=n):
        chosen = {i for i in range(n) if bits[i]}
        low = all(sum(i in chosen for i in range(n) if groups[i] == g)
                  >= math.ceil(groups.count(g) * 0.4) for g in set(groups))
        if len(chosen) <= cap and forced <= chosen and low:
            gain = sum(net[i] for i in chosen)
            best = gain if best is None else max(best, gain)
    df = frame(spark, values, risks, groups, forced)
    got = taken(selection.structural_optimum(df, 6, 0.8, "carrier", 0.4))
    assert len(got) <= cap and forced <= got
    assert sum(net[i] for i in got) == pytest.approx(best)


def test_metrics_of_no_unit(spark):
    df = frame(spark, [5, 7], [.1, .2]).withColumn("strategy", F.lit("none")).withColumn(
        "selected", F.lit(False))
    row = selection.decision_metrics(df, 10).first()
    assert (row.total_cost, row.operated, row.average_probability) == (12.0, 0, None)


@pytest.mark.parametrize("bad", [None, -0.1, 1.1, float("nan")])
def test_optima_refuse_what_is_no_probability(spark, bad):
    rows = [(i, "g", 100.0, 0.5 if i else bad, 0, False) for i in range(9)]
    df = spark.createDataFrame(rows, "unit_id long, grp string, value double, probability double, "
                                     "target int, mandatory boolean")
    for call in (lambda: selection.capacity_optimum(df, 10.0, 0.5),
                 lambda: selection.structural_optimum(df, 10.0, 0.5, "grp", 0.1),
                 lambda: selection.policies(df, 10.0, 0.5, "s"),
                 lambda: selection.scenarios(df, [10.0], [0.5])):
        with pytest.raises(ValueError, match="1 units"):
            call()
    assert selection.capacity_optimum(df.where("unit_id > 0"), 10.0, 0.5).count() == 8
