import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from punctua.functions.columns import seeded_hash
from punctua.operators import extra_trees, features, learners, neighbours
from punctua.operators.prepare import FEATURES
from punctua.session import stage

BASE = {n: {"params": {key: size, "learning_rate": 0.2}, "iterations": 3} for n, key, size in (
    ("xgboost", "max_depth", 3), ("lightgbm", "num_leaves", 8), ("catboost", "depth", 3))}


@pytest.fixture(scope="module")
def units(spark):
    """A signal in carrier and month, plus noise; a third of the rows share one carrier."""
    i = F.col("unit_id")
    rows = spark.range(900).withColumnRenamed("id", "unit_id").select(
        "unit_id",
        (2000 + i % 5).cast("int").alias("year"),
        (1 + i % 12).cast("int").alias("month"),
        F.when(i % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), i % 4)).alias("carrier"),
        F.concat(F.lit("P"), i % 7).alias("airport"),
        (1.0 + i % 11).alias("arr_flights"),
    )
    risk = 0.15 + 0.5 * (F.col("carrier") == "HOT").cast("int") + 0.02 * F.col("month")
    noise = seeded_hash("y", "unit_id") / F.lit(float(2**48))
    return stage(rows.withColumn("target", (noise < risk).cast("int")))


def auc(rows):
    p = np.array([r.probability for r in rows])
    y = np.array([r.target for r in rows])
    assert ((p >= 0) & (p <= 1)).all()
    gaps = p[y == 1][:, None] - p[y == 0][None, :]
    return ((gaps > 0) + (gaps == 0) / 2).mean()


def test_registry(units):
    assert learners.NAMES == [
        "random_forest", "extra_trees", "xgboost", "lightgbm", "catboost", "knn",
        "gaussian_nb", "mlp", "logistic_regression", "linear_svm", "stacking"]
    with pytest.raises(ValueError, match="Unknown"):
        learners.fit("nope", units, {}, 1)
    with pytest.raises(ValueError, match="Unknown"):
        learners.defaults("nope")


@pytest.mark.parametrize("name, params", [
    ("random_forest", {"n_estimators": 5, "max_depth": 4}),
    ("extra_trees", {"n_estimators": 5, "max_depth": 4}),
    ("lightgbm", {"n_estimators": 3, "num_leaves": 8}),
    ("logistic_regression", {"C": 1.0}),
    ("linear_svm", {"cv": 2}),
    ("mlp", {"hidden_layer_sizes": (4,), "max_iter": 15}),
])
def test_learner_beats_chance(units, name, params):
    rows = learners.fit(name, units, params, 7).score(units).collect()
    assert len(rows) == 900 and auc(rows) > 0.6


def test_stack_has_one_out_of_fold_value_per_row_and_base(units):
    model = learners.fit("stacking", units, {"folds": 2}, 7, specs=BASE)
    oof = model.info["oof"]
    assert oof.count() == 900
    assert oof.select(*learners.BOOSTING).dropna().count() == 900
    assert auc(model.score(units).collect()) > 0.6


def test_logistic_fit_is_the_ridge_optimum(units):
    model = learners.fit("logistic_regression", units, {"C": 0.5}, 7)
    encoded = features.fit_one_hot(units).transform(units).select("features", "target").collect()
    x = np.array([DenseVector(r.features.toArray()).toArray() for r in encoded])
    y = np.array([r.target for r in encoded])
    w, b = model.info["model"].coefficients.toArray(), model.info["model"].intercept
    residual = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ residual + w / 0.5).max() < 0.5
    assert abs(residual.sum()) < 0.5


@pytest.mark.parametrize("name, params", [
    ("random_forest", {"n_estimators": 3, "max_depth": 3}),
    ("extra_trees", {"n_estimators": 3, "max_depth": 3}),
    ("catboost", {"n_estimators": 2, "depth": 3}), ("knn", {"n_neighbors": 5}),
    ("gaussian_nb", {}), ("mlp", {"hidden_layer_sizes": (4,), "max_iter": 5}),
    ("logistic_regression", {}), ("linear_svm", {"cv": 2}), ("stacking", {"folds": 2}),
])
def test_loaded_model_scores_as_the_fitted_one(spark, units, tmp_path, name, params):
    specs = BASE if name == "stacking" else None
    model = learners.fit(name, units, params, 7, specs=specs)
    learners.save(spark, model, str(tmp_path / "m"))
    again = learners.load(spark, str(tmp_path / "m"))
    assert again.name == name
    new = units.withColumn("carrier", F.when(F.col("unit_id") % 50 == 0, "new").otherwise(
        F.col("carrier")))
    want = {r.unit_id: r.probability for r in model.score(new).collect()}
    assert {r.unit_id: r.probability for r in again.score(new).collect()} == want
    with pytest.raises(Exception):
        learners.save(spark, model, str(tmp_path / "m"))


def test_parameters_without_effect_are_refused(units):
    for name, params in (("xgboost", {"reg_lambda": 1.0}), ("mlp", {"alpha": 0.1}),
                         ("random_forest", {"max_depth": 40}), ("catboost", {"max_depth": 3})):
        with pytest.raises(ValueError):
            learners.fit(name, units, params, 7)


def test_patience(spark):
    losses = [5, 4, 3, 3, 4, 5, 2, 1]
    df = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(losses)],
                               "iteration int, loss double")
    assert learners.patience_stop(df, 3).first()[0] == 3
    assert learners.patience_stop(df, 4).first()[0] == 8


def test_network_stops_on_its_holdout(units):
    """The series ends ten iterations after its best one, whose weights are the model."""
    model = learners.fit("mlp", units, {"hidden_layer_sizes": (8,), "max_iter": 60}, 7)
    series = [(r.iteration, r.loss) for r in model.info["losses"].orderBy("iteration").collect()]
    best = model.info["best_iteration"]
    assert [i for i, _ in series] == list(range(5, 5 * len(series) + 1, 5))
    assert best == min(series, key=lambda r: (r[1], r[0]))[0]
    assert series[-1][0] == 60 or series[-1][0] - best == 10
    plain = learners.fit("mlp", units, {"hidden_layer_sizes": (8,), "max_iter": 5,
                                        "early_stopping": False}, 7)
    assert "losses" not in plain.info and auc(plain.score(units).collect()) > 0.5


def test_svm_planes_are_optimal_in_every_fold(units):
    from punctua.operators import newton
    model = learners.fit("linear_svm", units, {"cv": 2, "C": 0.5}, 7)
    encoded = stage(model.info["encoded"].select(
        "fold", "features", F.col("target").cast("double").alias("label")))
    assert len(model.info["planes"]) == len(model.state.numbers["sigmoids"]) == 2
    for fold, plane in enumerate(model.info["planes"]):
        gradient = newton.hinge_gradient(encoded.where(F.col("fold") != fold), plane, 0.5)
        assert gradient.agg(F.max(F.abs("gradient"))).first()[0] < 1e-6


def test_early_stopping_reports_a_round(units):
    model = learners.early_stopped("xgboost", units, {"max_depth": 3, "learning_rate": 0.5},
                                   7, "unit_id", 6, 2)
    assert 1 <= model.info["best_iteration"] <= 6


@pytest.mark.parametrize("p, weights", [(2, "uniform"), (1, "distance")])
def test_knn_equals_brute_force(spark, monkeypatch, p, weights):
    monkeypatch.setattr(neighbours, "LEAF", 20)
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    rng = np.random.default_rng(5)
    points = rng.integers(0, 9, (240, 3)).astype(float)
    points[::3] = [4.0, 4.0, 4.0]  # a third of the rows are one point
    y = rng.integers(0, 2, 240)
    asked = np.vstack([rng.integers(-3, 12, (40, 3)), [[4, 4, 4]] * 20]).astype(float)
    train = spark.createDataFrame(
        [(i, *map(float, x), int(t)) for i, (x, t) in enumerate(zip(points, y))],
        "id long, a double, b double, c double, y int")
    test = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(asked)],
                                 "id long, a double, b double, c double")
    scale, k = [1.0, 2.0, 0.7], 7
    got = {r.id: r.probability for r in neighbours.knn_probability(
        train, test, ["a", "b", "c"], scale, "id", "y", k, p, weights).collect()}
    for i, q in enumerate(asked):
        gap = np.abs(points - q) / scale
        d = np.round(gap.sum(1) if p == 1 else (gap * gap).sum(1), 9)
        near = sorted(range(240), key=lambda j: (d[j], j))[:k]
        if weights == "uniform":
            want = y[near].mean()
        elif (d[near] == 0).any():
            want = y[[j for j in near if d[j] == 0]].mean()
        else:
            pull = 1 / (d[near] if p == 1 else np.sqrt(d[near]))
            want = (pull * y[near]).sum() / pull.sum()
        assert got[i] == pytest.approx(want), i


@pytest.mark.parametrize("p", [1, 2])
def test_queries_of_a_sparse_corner_visit_few_cells(p):
    """A cell of fewer than k points takes the far side of a larger box, not every cell."""
    import pandas as pd
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(4000, 2)), [[40, 40], [41, 40], [40, 42]]])
    scale, k = np.array([1.0, 2.0]), 5
    nodes = neighbours._tree(points, 256)
    frame = pd.DataFrame(points, columns=["a", "b"]).assign(cell=neighbours._descend(nodes, points))
    grouped = frame.groupby("cell")
    boxes = grouped.agg(rows=("a", "size"), lo_a=("a", "min"), lo_b=("b", "min"), hi_a=("a", "max"),
                        hi_b=("b", "max")).reset_index()
    low, high, count = neighbours._node_boxes(nodes, boxes, ["a", "b"])
    assert count[0] == len(points)
    asked = np.vstack([points[::50], [[45, 45], [-9, -9], [40, 40.0]]])
    bound = neighbours._far_sides(nodes, low, high, count, asked, k, scale, p)
    gap = np.abs(asked[:, None, :] - points[None]) / scale
    d = np.sort(gap.sum(axis=2) if p == 1 else (gap * gap).sum(axis=2), axis=1)
    assert np.isfinite(bound).all() and (bound >= d[:, k - 1]).all()
    inner = neighbours._box_hits(nodes, low, high, asked[:-3], bound[:-3], scale, p)
    assert np.mean([len(h) for h in inner]) < 0.25 * len(boxes)


def test_extra_trees_leaf_values_are_class_shares(units):
    encoded = features.fit_ordinal(units).transform(units)
    model = extra_trees.fit(encoded, features.ORDINAL, "target", trees=2, max_depth=3, min_leaf=5)
    data = encoded.select(*features.ORDINAL, "target").toPandas()
    x, y = data[features.ORDINAL].to_numpy(float), data["target"].to_numpy()
    for tree in (0, 1):
        at = model.leaves(x, tree)
        for leaf in np.unique(at):
            assert model.value[leaf] == pytest.approx(y[at == leaf].mean())
            assert (at == leaf).sum() >= 5


def test_encoding_literals(spark):
    train = spark.createDataFrame(
        [(2000, 1, "B", "X", 1.0), (2000, 2, "A", "X", 2.0), (2000, 3, "A", "Y", 3.0),
         (2000, 4, "A", "X", 10.0)],
        "year int, month int, carrier string, airport string, arr_flights double")
    assert features.medians(train, ["arr_flights"]) == {"arr_flights": 2.5}
    assert features.moments(train, ["year"])["year"][1] == 1.0
    other = spark.createDataFrame([(2000, 1, "Z", "Y", None)], train.schema)
    row = features.fit_ordinal(train).transform(other).first()
    assert (row.x_carrier, row.x_airport, row.x_arr_flights) == (-1.0, 1.0, 2.5)
    codes = features.category_codes(train, "carrier")
    slots = {r.carrier: r.slot for r in features.category_slots(codes, "carrier").collect()}
    assert slots == {"A": 0, "B": 1}
    vector = features.fit_one_hot(train).transform(other).first().features.toArray()
    assert len(vector) == 2 + 2 + 3 and list(vector[:2]) == [0.0, 0.0]
    assert set(FEATURES) <= set(train.columns)
