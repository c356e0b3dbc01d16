"""Boosted trees grown inside one task against Spark's fits of the same settings."""

import numpy as np
import pytest

from punctua.operators import grown, learners, split, tune
from punctua.session import stage

PARAMS = {"num_leaves": 15, "min_child_samples": 5, "learning_rate": 0.3}
SPECS = {n: {"params": {key: size, "learning_rate": 0.2}, "iterations": 4} for n, key, size in (
    ("xgboost", "max_depth", 3), ("lightgbm", "num_leaves", 8), ("catboost", "depth", 2))}


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(11)
    rows = [(i, 2000 + int(rng.integers(6)), 1 + int(rng.integers(12)), f"C{rng.integers(4)}",
             f"P{rng.integers(9)}", float(rng.normal(50, 9))) for i in range(700)]
    target = [int(rng.random() < 0.2 + 0.4 * (r[3] == "C1") + 0.02 * r[2]) for r in rows]
    return stage(spark.createDataFrame(
        [(*r, t) for r, t in zip(rows, target)], "unit_id long, year int, month int, "
        "carrier string, airport string, arr_flights double, target int"))


@pytest.fixture
def by_spark(monkeypatch):
    """What a call gives where no fit is small enough for one task."""
    def run(call):
        with monkeypatch.context() as patched:
            patched.setattr(learners, "IN_TASK_ROWS", 0)
            return call()

    return run


@pytest.fixture
def no_jobs_per_level(monkeypatch):
    def refuse(*args):
        raise AssertionError("a fit by one job per level of every round")

    monkeypatch.setattr(learners, "_gbt", refuse)


def scores(model, df):
    return {r.unit_id: r.probability for r in model.score(df).collect()}


def near(values, gap=1e-9):
    return {k: pytest.approx(v, abs=gap) for k, v in values.items()}


def test_edges():
    assert grown.edges(np.array([1.0, 4, 2, 2]), 32).tolist() == [1.5, 3.0]
    assert len(grown.edges(np.ones(5), 32)) == 0
    cuts = grown.edges(np.arange(1000.0), 4)
    assert len(cuts) == 3 and np.abs(cuts - [249.5, 499.5, 749.5]).max() <= 1


def test_fold_tables_equal_those_of_spark(units, by_spark, request):
    """the fits of a search are tasks of one job."""
    folded = stage(split.stratified_folds(units, 2, "f", "unit_id"))
    protocol = tune.Protocol(inner_folds=2, max_rounds=12, patience=3)
    params = [PARAMS, PARAMS | {"num_leaves": 4}]

    def table():
        found = tune.cross_validate("lightgbm", folded, params, protocol, 5)
        return {(r.candidate, r.fold): (r.best_iteration, pytest.approx(r.roc_auc, abs=1e-9),
                                        pytest.approx(r.brier, abs=1e-9)) for r in found.collect()}

    want = by_spark(table)
    request.getfixturevalue("no_jobs_per_level")
    assert len(want) == 4 and table() == want


def test_early_stop_equals_that_of_spark(units, by_spark, request):
    """the series ends by itself, without rounds fitted again."""
    def model():
        return learners.early_stopped("lightgbm", units, PARAMS, 7, "unit_id", 40, 4)

    want = by_spark(model)
    request.getfixturevalue("no_jobs_per_level")
    got = model()
    assert got.info["best_iteration"] == want.info["best_iteration"] < 40
    assert len(got.info["trees"].root) == got.info["best_iteration"]
    assert scores(got, units) == near(scores(want, units))


def test_stack_equals_that_of_spark(units, by_spark, request):
    """base models and stack; the meta-model is fitted to a tolerance."""
    def model():
        return learners.fit("stacking", units, {"folds": 2}, 7, specs=SPECS)

    want = scores(by_spark(model), units)
    request.getfixturevalue("no_jobs_per_level")
    assert scores(model(), units) == near(want, 1e-3)


def test_out_of_fold_scores_equal_those_of_spark(units, by_spark, request):
    """the fits of all folds and bases are tasks of one job."""
    folded = stage(split.stratified_folds(units, 3, "f", "unit_id"))

    def long():
        rows = learners.out_of_fold(folded, SPECS, 3, 7, "unit_id").collect()
        return {(r.unit_id, r.target, r.fold, r.model): r.probability for r in rows}

    want = near(by_spark(long))
    request.getfixturevalue("no_jobs_per_level")
    assert len(want) == 2100 and long() == want


def test_draws_depend_on_the_seed_alone(units):
    params = {"max_depth": 3, "subsample": 0.5, "colsample_bytree": 0.6, "n_estimators": 5}

    def values(df, seed):
        return learners.fit("xgboost", df, params, seed).info["trees"].value.tolist()

    first = values(units, 1)
    assert values(units.repartition(5, "airport"), 1) == first != values(units, 2)


def test_classes_and_rows_are_needed():
    with pytest.raises(ValueError, match="rows"):
        grown.table(np.zeros((0, 2)), np.zeros(0))
    with pytest.raises(ValueError, match="Classes"):
        grown.table(np.zeros((2, 2)), np.array([0.0, 2.0]))


def test_binned_tree_equals_that_of_spark(units):
    """a tree without draws, with sibling leaves of one class merged."""
    from pyspark.ml.classification import DecisionTreeClassifier

    transform, _, _ = learners._ordinal(units)
    x, y, more = learners.few(transform(units), "unit_id")
    rows = grown.table(x, y)
    tree, _ = grown.grow(rows.bins, rows.label, len(y), 32, 6, 3, 5, None)
    trees = grown._joined([grown._merged(tree)], rows.cuts)
    fit = DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=3, labelCol="target").fit(
        transform(units))
    want = {r.unit_id: r.probability[1] for r in fit.transform(transform(units)).collect()}
    assert len(trees.left) == fit.numNodes
    assert dict(zip(more["unit_id"].to_pylist(), grown.shares(trees, x))) == near(want)


@pytest.mark.parametrize("name", learners.FORESTS)
def test_forest_in_tasks(units, by_spark, monkeypatch, name):
    """a forest and its search need no job per level; every tree keeps its draws."""
    params = {"n_estimators": 40, "max_depth": 6, "min_samples_leaf": 4}
    folded = stage(split.stratified_folds(units, 2, "f", "unit_id"))
    protocol = tune.Protocol(inner_folds=2)

    def aucs():
        table = tune.cross_validate(name, folded, [params], protocol, 5)
        return [r.roc_auc for r in table.orderBy("fold").collect()]

    want = by_spark(aucs)

    def refuse(*args, **named):
        raise AssertionError("a fit by one job per level")

    monkeypatch.setattr(learners, "_fit_on", refuse)
    monkeypatch.setattr(learners.extra_trees, "fit", refuse)
    assert aucs() == pytest.approx(want, abs=0.08) and min(want) > 0.6
    model = learners.fit(name, units, params, 7).info.get("trees")
    if model is not None:
        assert len(model.root) == 40
    first = scores(learners.fit(name, units, params, 7), units)
    monkeypatch.setattr(learners, "FOREST_TASK", 7)
    assert scores(learners.fit(name, units, params, 7), units) == near(first)


def test_extra_trees_in_tasks_keep_their_rules():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=300), np.ones(300), rng.integers(3, size=300)])
    y = (rng.random(300) < 0.3 + 0.4 * (x[:, 0] > 0)).astype(float)
    settings = {"bagged": False, "depth": 5, "least": 6, "picked": 2}
    trees = grown.forest(grown.table(x, y), settings, 3, range(4))
    assert not (trees.feature[trees.left >= 0] == 1).any()  # a constant column is never drawn
    for tree in range(4):
        at = trees.leaves(x, tree)
        for leaf in np.unique(at):
            assert trees.value[leaf] == pytest.approx(y[at == leaf].mean())
            assert (at == leaf).sum() >= 6
