import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from punctua.functions.columns import seeded_hash
from punctua.operators import learners, newton, tune
from punctua.session import stage


def noise(name):
    return seeded_hash(name, "id") / F.lit(float(2 ** 48))


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1200).select(
        "id", (noise("a") * 3).alias("a"), (noise("b") - 0.5).alias("b"),
        (F.col("id") % 3).cast("int").alias("fold"))
    z = F.col("a") - 2 * F.col("b") - 1.2
    return stage(df.withColumn("target", (noise("y") < 1 / (1 + F.exp(-z))).cast("int")))


def reference(rows, columns, c):
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    model = LogisticRegression(labelCol="target", maxIter=1000, tol=1e-13,
                               **learners._ridge(rows.count(), c)).fit(vectors)
    return np.append(model.coefficients.toArray(), model.intercept)


def test_batch_equals_single_fits(rows):
    """Models of other rows and other penalties in one batch equal Spark's own fits."""
    members = F.get(F.array(F.array(F.lit(0), F.lit(2)), F.array(F.lit(0)), F.array(F.lit(1))), "fold")
    cs = [0.01, 5.0, 100.0, 1.0]
    got = newton.logistic_fits(rows, ["a", "b"], F.col("target"), members, [1 / c for c in cs])
    parts = [rows.where("fold < 2"), rows.where("fold = 2"), rows.where("fold = 0")]
    for m, part in enumerate(parts):
        assert np.abs(got[m] - reference(part, ["a", "b"], cs[m])).max() < 1e-6
    assert not got[3].any()  # no rows


def test_meta_fits_are_those_of_each_candidate_and_fold(rows):
    oof = rows.select("id", "fold", "target", F.col("a").alias("xgboost"), F.col("b").alias("lightgbm"),
                      (F.col("a") * F.col("b")).alias("catboost"))
    params = [{"C": 0.01}, {"C": 10.0}]
    got = tune.meta_fits(oof, params, 3)
    assert got.shape == (6, 4)
    for c, f in ((0, 0), (1, 2)):
        want = reference(oof.where(F.col("fold") != f), learners.BOOSTING, params[c]["C"])
        assert np.abs(got[c * 3 + f] - want).max() < 1e-6
    found = tune.meta_search(oof, params, 3).collect()
    assert sorted((r.candidate, r.fold) for r in found) == [(c, f) for c in range(2) for f in range(3)]
    assert all(0.5 < r.roc_auc < 1 for r in found)


def test_separated_rows_do_not_diverge(spark):
    rows = spark.createDataFrame([(float(x), int(x > 0)) for x in (-3, -2, -1, 1, 2, 50)], "x double, y int")
    w = newton.logistic_fits(rows, ["x"], F.col("y"), F.array(F.lit(0)), [1.0])[0]
    x, y = np.array([-3, -2, -1, 1, 2, 50.0]), np.array([0, 0, 0, 1, 1, 1])
    p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
    assert abs(((p - y) * x).sum() + w[0]) < 1e-8 and abs((p - y).sum()) < 1e-8


def test_sigmoids_of_all_models_at_once(rows):
    margins = rows.select(F.col("fold").alias("model"), F.col("a").alias("margin"), "target")
    got = newton.platt(margins, 4)
    for m in range(3):
        part = np.array([(r.margin, r.target) for r in margins.where(F.col("model") == m).collect()])
        p, n = part[:, 1].sum(), (1 - part[:, 1]).sum()
        soft = np.where(part[:, 1] == 1, (p + 1) / (p + 2), 1 / (n + 2))
        gap = 1 / (1 + np.exp(-(got[m, 0] * part[:, 0] + got[m, 1]))) - soft
        assert abs(gap.sum()) < 1e-7 and abs((gap * part[:, 0]).sum()) < 1e-7
    assert not got[3].any()


def hinge_rows(rows):
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    return vectors.select("features", F.col("target").cast("double").alias("label"))


@pytest.mark.parametrize("c", [0.01, 1.0, 50.0])
def test_squared_hinge_is_at_its_optimum(rows, c):
    table = hinge_rows(rows)
    plane = newton.squared_hinge(table, c)
    found = table.collect()
    x = np.array([np.append(r.features.toArray(), 1.0) for r in found])
    y = np.array([2 * r.label - 1 for r in found])
    w = plane.weights
    gap = np.maximum(0, 1 - y * (x @ w))
    gradient = w - 2 * c * (x.T @ (y * gap))
    assert np.abs(gradient).max() < 1e-6 * max(1.0, c)
    listed = {r.slot: r.gradient for r in newton.hinge_gradient(table, plane, c).collect()}
    assert np.abs(np.array([listed[k] for k in range(3)]) - gradient).max() < 1e-6

    def cost(v):
        return v @ v / 2 + c * (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()

    for step in np.eye(3) * 1e-3:
        assert cost(w) < cost(w + step) and cost(w) < cost(w - step)


def test_squared_hinge_of_one_class_and_of_no_rows(spark):
    rows = spark.createDataFrame([(float(k), 1.0) for k in range(5)], "a double, label double")
    vectors = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    plane = newton.squared_hinge(vectors, 10.0)
    x = np.array([[k, 1.0] for k in range(5)])
    gradient = plane.weights - 20 * (x.T @ np.maximum(0, 1 - x @ plane.weights))
    assert np.abs(gradient).max() < 1e-6
    with pytest.raises(ValueError, match="rows"):
        newton.squared_hinge(vectors.limit(0), 1.0)
