"""The eleven named classifiers (M1-M14): fit on a training table, score any table.

A training table has the five features, ``target`` and an id column. Encodings are fitted
inside each fit, so a cross-validation fold never sees statistics of its held-out rows.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from punctua.operators import extra_trees, features, grown, neighbours, newton, split, stored
from punctua.operators.prepare import FEATURES
from punctua.operators.stored import State
from punctua.session import collected, settle, small_table, stage

NAMES = [
    "random_forest", "extra_trees", "xgboost", "lightgbm", "catboost", "knn", "gaussian_nb",
    "mlp", "logistic_regression", "linear_svm", "stacking",
]
BOOSTING = ["xgboost", "lightgbm", "catboost"]
FORESTS = ["random_forest", "extra_trees"]
MAX_DEPTH = 30  # the deepest tree Spark grows; None means this depth
TREE_PARAMETERS = {"n_estimators", "max_depth", "min_samples_leaf", "max_features"}
TASK_ROWS = 65_536  # rows of a fit that one task holds at least; every round of a fit is a job
IN_TASK_ROWS = 200_000  # trees on up to so many rows are grown in tasks; others by jobs per level
FOREST_ROWS = 10_000_000  # rows times trees of a forest whose tasks return it to the driver
FOREST_TASK = 25  # trees that a task grows
NETWORK_STAGE = 5  # iterations of the network between two looks at its holdout
PARALLEL = 8  # fits of one learner that run as concurrent jobs


def _depth(params: dict) -> int:
    depth = params.get("max_depth") or MAX_DEPTH
    if depth > MAX_DEPTH:
        raise ValueError(f"Trees are at most {MAX_DEPTH} levels deep.")
    return depth


@dataclass(frozen=True)
class Scorer:
    """A fitted classifier: ``score`` adds ``probability``, P(target = 1)."""

    state: State
    score: Callable[[DataFrame], DataFrame]
    info: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.state.name


def scorer(state: State, info: dict | None = None) -> Scorer:
    """The score function of a state, fitted or loaded."""
    kind = "boosting" if state.name in BOOSTING else state.name
    return Scorer(state, SCORES[kind](state), info or {})


def save(spark: SparkSession, model: Scorer, path: str) -> None:
    """Write a fitted model into a new folder (K6)."""
    stored.save(spark, model.state, path)


def load(spark: SparkSession, path: str) -> Scorer:
    """A model as it was saved: scores are those of the fitted one."""
    return scorer(stored.load(spark, path))


def _classified(transform, model):
    """Score by one Spark model on the vectors that ``transform`` makes."""
    if model.numClasses != 2:
        raise ValueError("A model of two classes is needed.")

    def score(df: DataFrame) -> DataFrame:
        p = vector_to_array("probability")[1]
        return model.transform(transform(df)).withColumn("probability", p).select(
            *df.columns, "probability")

    return score


def _on_ordinal(state: State):
    encoding = stored.ordinal(state)
    columns = features.SCALED if encoding.scale else features.ORDINAL
    return _classified(lambda df: features.assemble(encoding.transform(df), columns),
                       state.models["model"])


def _on_one_hot(state: State):
    return _classified(stored.one_hot(state).transform, state.models["model"])


def _ordinal(train: DataFrame, scaled: bool = False):
    """(transform to vectors, numbers, tables) of an encoding fitted on ``train``."""
    encoding = features.fit_ordinal(train, scaled)
    columns = features.SCALED if scaled else features.ORDINAL
    return (lambda df: features.assemble(encoding.transform(df), columns),
            *stored.of_ordinal(encoding))


def _refuse(name: str, params: dict, known: set[str]) -> None:
    """Every parameter must have an effect."""
    unknown = sorted(set(params) - known)
    if unknown:
        raise ValueError(f"{name} has no parameter {', '.join(unknown)}.")


def require_known(name: str, params: dict) -> None:
    _refuse(name, params, {"knn": {"n_neighbors", "p", "weights"}, "linear_svm": {"C", "cv"},
                           "logistic_regression": {"C"}}[name])


def _vectors(encoded: DataFrame) -> DataFrame:
    """Feature vectors and labels, held for the many passes of a fit."""
    return encoded.select("features", F.col("target").cast("double").alias("label")).persist()


def _gathered(held: DataFrame) -> DataFrame:
    """Held rows in no more tasks than their number needs, as a fit has thousands of short jobs."""
    return held.coalesce(max(1, ceil(held.count() / TASK_ROWS)))


def few(encoded: DataFrame, *columns: str, bound: int | None = None):
    """Feature vectors (row, feature) and classes of encoded rows, then an Arrow table of more
    columns; None beyond IN_TASK_ROWS, or a lower bound."""
    x, y = vector_to_array("features").alias("_x"), F.col("target").cast("double").alias("_y")
    rows = IN_TASK_ROWS if bound is None else min(bound, IN_TASK_ROWS)
    table = collected(encoded.select(x, y, *columns), rows)
    if table is None:
        return None
    values = table["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return (values.reshape(table.num_rows, -1), table["_y"].to_numpy(),
            table.select(list(columns)))


def _fit_on(estimator, encoded: DataFrame):
    held = _vectors(encoded)
    try:
        return _spread_out(estimator, _gathered(held))
    finally:
        held.unpersist()


def _spread_out(estimator, rows: DataFrame):
    """The fit of an estimator. Trees keep the nodes of rows in a cache only where the rows lie in
    several tasks; for one task the cache costs more than it saves."""
    if estimator.hasParam("cacheNodeIds"):
        estimator.set(estimator.getParam("cacheNodeIds"), rows.rdd.getNumPartitions() > 1)
    return estimator.setParams(featuresCol="features", labelCol="label").fit(rows)


def _pooled(function: Callable, tasks: list, parallel: int = PARALLEL) -> list:
    """Results in order; fits run as concurrent jobs."""
    with ThreadPoolExecutor(min(parallel, max(1, len(tasks)))) as pool:
        return list(pool.map(function, tasks))


# -- trees -----------------------------------------------------------------------------------

def _subset(fraction) -> str:
    if fraction in ("sqrt", "all", "log2", "onethird"):
        return fraction
    return "all" if float(fraction) >= 1 else str(float(fraction))


def forest_settings(name: str, params: dict) -> dict:
    """How a tree of a forest is grown in a task, with the numbers of features that Spark's forest
    and the extra trees draw for a node."""
    _refuse(name, params, TREE_PARAMETERS)
    d, asked = len(FEATURES), params.get("max_features", "sqrt")
    if name == "extra_trees":
        picked = extra_trees._feature_count(asked, d)
    else:
        part = _subset(asked)
        picked = {"sqrt": ceil(sqrt(d)), "all": d, "log2": max(1, ceil(log2(d))),
                  "onethird": ceil(d / 3)}.get(part) or ceil(float(part) * d)
    return {"bagged": name == "random_forest", "depth": _depth(params), "picked": picked,
            "least": params.get("min_samples_leaf", 1)}


def _forest_in_tasks(encoded: DataFrame, settings: dict, count: int,
                     seed: int) -> extra_trees.Trees | None:
    """The trees of a forest, some in each task of one job; None if they are too many rows."""
    found = few(encoded)
    if not found or len(found[0]) * count > FOREST_ROWS:
        return None
    rows = grown.table(*found[:2])

    def run(numbers):
        return vars(grown.forest(rows, settings, seed, numbers))

    parts = [range(i, min(i + FOREST_TASK, count)) for i in range(0, count, FOREST_TASK)]
    arrays = encoded.sparkSession.sparkContext.parallelize(parts, len(parts)).map(run).collect()
    trees = grown.combined([extra_trees.Trees(**a) for a in arrays])
    if not settings["bagged"] and len(trees.left) > extra_trees.MAX_NODES:
        raise ValueError("The trees outgrow the driver: lower max_depth or raise min_leaf.")
    return trees


def random_forest(train: DataFrame, params: dict, seed: int) -> Scorer:
    settings = forest_settings("random_forest", params)
    transform, numbers, tables = _ordinal(train)
    trees = _forest_in_tasks(transform(train), settings, params.get("n_estimators", 300), seed)
    if trees is not None:
        tables = {**tables, "trees": _packed(train.sparkSession, trees)}
        return scorer(State("random_forest", numbers, tables), {"trees": trees})
    forest = RandomForestClassifier(
        numTrees=params.get("n_estimators", 300), maxDepth=_depth(params),
        minInstancesPerNode=params.get("min_samples_leaf", 1),
        featureSubsetStrategy=_subset(params.get("max_features", "sqrt")), seed=seed,
    )
    model = _fit_on(forest, transform(train))
    return scorer(State("random_forest", numbers, tables, {"model": model}), {"model": model})


def extra_trees_model(train: DataFrame, params: dict, seed: int) -> Scorer:
    settings = forest_settings("extra_trees", params)
    encoding = features.fit_ordinal(train)
    encoded, count = encoding.transform(train), params.get("n_estimators", 300)
    trees = _forest_in_tasks(features.assemble(encoded, features.ORDINAL), settings, count, seed)
    if trees is None:
        trees = extra_trees.fit(
            encoded, features.ORDINAL, "target", trees=count, max_depth=_depth(params),
            min_leaf=params.get("min_samples_leaf", 1),
            max_features=params.get("max_features", "sqrt"), seed=seed,
        )
    numbers, tables = stored.of_ordinal(encoding)
    tables["trees"] = _packed(train.sparkSession, trees)
    return scorer(State("extra_trees", numbers, tables))


def _packed(spark: SparkSession, trees: extra_trees.Trees) -> DataFrame:
    arrays = {k: (str(v.dtype), v.tobytes()) for k, v in vars(trees).items()}
    return small_table(spark, [(k, *v) for k, v in arrays.items()],
                       "part string, kind string, content binary")


def _unpacked(state: State) -> extra_trees.Trees:
    return extra_trees.Trees(**{r["part"]: np.frombuffer(r["content"], dtype=r["kind"])
                                for r in state.tables["trees"].collect()})


def _forest_score(state: State):
    if "trees" not in state.tables:
        return _on_ordinal(state)
    encoding, trees = stored.ordinal(state), _unpacked(state)

    def score(df):
        wide = extra_trees.predict(trees, encoding.transform(df), features.ORDINAL)
        return wide.select(*df.columns, "probability")

    return score


SHARED = {"n_estimators", "learning_rate"}
BOOSTING_PARAMETERS = {
    "xgboost": SHARED | {"max_depth", "min_child_weight", "subsample", "colsample_bytree"},
    "lightgbm": SHARED | {"num_leaves", "max_depth", "min_child_samples", "subsample",
                          "colsample_bytree"},
    "catboost": SHARED | {"depth"},
}


def boosting_settings(name: str, params: dict) -> dict:
    """Spark settings for the three boosting models.

    All three are Spark's gradient-boosted trees, grown level by level to a depth; they differ
    in the names of their parameters only. A parameter without a counterpart is an error.
    """
    _refuse(name, params, BOOSTING_PARAMETERS[name])
    depth = {"xgboost": params.get("max_depth", 6), "catboost": params.get("depth", 6)}.get(name)
    if name == "lightgbm":
        depth = ceil(log2(params.get("num_leaves", 31)))
        if params.get("max_depth", -1) > 0:
            depth = min(depth, params["max_depth"])
    return {
        "maxDepth": depth,
        "stepSize": params.get("learning_rate", 0.05),
        "subsamplingRate": params.get("subsample", 1.0),
        "featureSubsetStrategy": _subset(params.get("colsample_bytree", 1.0)),
        "minInstancesPerNode": int(
            params.get("min_child_weight", params.get("min_child_samples", 1))
        ),
    }


def _rounds(params: dict, iterations: int | None) -> int:
    return int(iterations or params.get("n_estimators") or 300)


def _gbt(name: str, params: dict, seed: int, rounds: int) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, seed=seed, **boosting_settings(name, params))


def boosting(name: str) -> Callable:
    def fit(train: DataFrame, params: dict, seed: int, iterations: int | None = None,
            encoded=None) -> Scorer:
        """``encoded`` is the encoding of ``train`` as ``_ordinal`` gives it, if it is known."""
        transform, numbers, tables = encoded or _ordinal(train)
        rounds, settings = _rounds(params, iterations), boosting_settings(name, params)
        found = few(transform(train))
        if found:
            trees, _ = _in_task(train.sparkSession, grown.table(*found[:2]), settings, rounds, seed)
            return _of_trees(train.sparkSession, name, numbers, tables, trees, {"iterations": rounds})
        model = _fit_on(_gbt(name, params, seed, rounds), transform(train))
        return scorer(State(name, numbers, tables, {"model": model}),
                      {"model": model, "iterations": rounds})

    return fit


def _in_task(spark: SparkSession, rows: grown.Table, settings: dict, rounds: int, seed: int,
             patience: int | None = None) -> tuple[extra_trees.Trees, int]:
    """``grown.boost`` as a job of one task."""
    def run(_):
        trees, best = grown.boost(rows, settings, rounds, seed, patience)
        return vars(trees), best

    arrays, best = spark.sparkContext.parallelize([0], 1).map(run).collect()[0]
    return extra_trees.Trees(**arrays), best


def held_scores(spark: SparkSession, fits: list, key: T.StructField,
                tables: list, held: list, kinds: list[T.StructField]) -> DataFrame:
    """Scores of the rows held out of a fold by every fit: (key, kinds..., probability,
    best_iteration), staged.

    A fit is a task of one job, which scores the held rows as well; long fits begin first. ``held`` has the rows of each fold as ``few`` gives them, ``kinds`` their columns.
    """
    fits = sorted(fits, key=lambda fit: fit.cost, reverse=True)
    schema = T.StructType([key, *kinds, T.StructField("probability", T.DoubleType()),
                           T.StructField("best_iteration", T.IntegerType())])
    shape = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                own = fits[number]
                x, _, others = held[own.fold]
                p, best = own.scored(tables[own.fold], x)
                columns = [pa.array([own.key] * len(x)), *others.columns, pa.array(p),
                           pa.array([best] * len(x))]
                scored = pa.Table.from_arrays(columns, names=shape.names)
                yield from scored.cast(shape).to_batches()

    return stage(spark.range(0, len(fits), 1, len(fits)).mapInArrow(run, schema), "held")


def _of_trees(spark: SparkSession, name: str, numbers: dict, tables: dict,
              trees: extra_trees.Trees, info: dict) -> Scorer:
    tables = {**tables, "trees": _packed(spark, trees)}
    return scorer(State(name, numbers, tables), {"trees": trees, **info})


def _boosting_score(state: State):
    if "trees" not in state.tables:
        return _on_ordinal(state)
    encoding, trees = stored.ordinal(state), _unpacked(state)

    def score(df):
        vectors = features.assemble(encoding.transform(df), features.ORDINAL)
        wide = vectors.withColumn("_x", vector_to_array("features"))
        return grown.predict(trees, wide, "_x").select(*df.columns, "probability")

    return score


def patience_stop(losses: DataFrame, patience: int, by: list[str] | None = None) -> DataFrame:
    """Best iteration per series under early stopping (M13): (by..., best_iteration).

    ``losses`` has (by..., iteration, loss), iterations from 1 and at most a few thousand per
    series. The series ends at the first iteration that is ``patience`` past the best so far.
    """
    by = list(by or [])
    running = W.partitionBy(*by).orderBy("iteration")
    best = F.min(F.struct("loss", "iteration")).over(running)["iteration"]
    rows = losses.withColumn("_best", best)
    late = F.col("iteration") - F.col("_best") >= patience
    stopped = F.min(F.when(late, F.struct("iteration", "_best")))
    last = F.max(F.struct("iteration", "_best"))
    return rows.groupBy(*by).agg(F.coalesce(stopped["_best"], last["_best"])
                                 .alias("best_iteration"))


@dataclass(frozen=True)
class Sides:
    """Rows of a fit that stops early: vectors to train on and to check, held, with the encoding
    (fitted on the rows to train on). ``table`` has them instead, where one task grows the trees."""

    fit: DataFrame | None
    check: DataFrame | None
    encoding: tuple
    held: list[DataFrame]
    table: grown.Table | None = None

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def stopping_sides(train: DataFrame, seed: str, id_col: str, share: float = 0.10,
                   scaled: bool = False, trees: bool = False) -> Sides:
    """A stratified holdout of ``train`` and the rest, encoded and held; for ``trees`` as a table,
    if the rows are few."""
    marked = stage(split.holdout(train, seed, id_col, share), "holdout")
    inner = marked.where(~F.col("is_validation"))
    encoding = _ordinal(inner, scaled)
    found = few(encoding[0](marked), "is_validation") if trees else None
    if found:
        x, y, more = found
        checked = more["is_validation"].to_numpy()
        return Sides(None, None, encoding, [],
                     grown.table(x[~checked], y[~checked], x[checked], y[checked]))
    fit_rows = _vectors(encoding[0](inner))
    check = _vectors(encoding[0](marked.where("is_validation")))
    return Sides(_gathered(fit_rows), _gathered(check), encoding, [fit_rows, check])


def early_stopped(name: str, train: DataFrame, params: dict, seed: int, id_col: str,
                  max_rounds: int, patience: int, sides: Sides | None = None) -> Scorer:
    """Boosting with a 10 % stratified holdout from inside the training rows.

    A fit inside one task ends as soon as the loss series of the holdout has run out of patience,
    or at the ceiling, and keeps the trees up to the best round. Otherwise the number of rounds is
    doubled until then, and the best round is refitted (a boosted model is the same up to that
    round). ``sides`` are those of ``train``, where several fits share them.
    """
    own = sides or stopping_sides(train, f"stop{seed}", id_col, trees=True)
    _, numbers, tables = own.encoding
    if own.table is not None:
        trees, best = _in_task(train.sparkSession, own.table, boosting_settings(name, params),
                               max_rounds, seed, patience)
        return _of_trees(train.sparkSession, name, numbers, tables, trees,
                         {"best_iteration": best, "iterations": best})
    rounds = min(max_rounds, max(2 * patience, 10))
    while True:
        model = _spread_out(_gbt(name, params, seed, rounds), own.fit)
        series = model.evaluateEachIteration(own.check)
        losses = small_table(
            train.sparkSession, [(i + 1, float(x)) for i, x in enumerate(series)],
            "iteration int, loss double",
        )
        best = max(patience_stop(losses, patience).first()["best_iteration"], 1)
        if rounds - best >= patience or rounds >= max_rounds:
            break
        rounds = min(rounds * 2, max_rounds)
    if best < rounds:
        model = _spread_out(_gbt(name, params, seed, best), own.fit)
    if sides is None:
        own.release()
    return scorer(State(name, numbers, tables, {"model": model}),
                  {"model": model, "best_iteration": best, "iterations": best})


# -- neighbours, Bayes, networks ---------------------------------------------------------------

def knn(train: DataFrame, params: dict, seed: int, id_col: str = "unit_id") -> Scorer:
    require_known("knn", params)
    encoding = features.fit_ordinal(train, scaled=True)
    numbers, tables = stored.of_ordinal(encoding)
    tables["train"] = stage(
        encoding.transform(train).select(id_col, *features.ORDINAL, "target"), "knn")
    return scorer(State("knn", {**numbers, "params": params, "id": id_col}, tables))


def _knn_score(state: State):
    encoding, params, id_col = stored.ordinal(state), state.numbers["params"], state.numbers["id"]
    stds = [encoding.scale[c][1] for c in features.ORDINAL]

    def score(df):
        found = neighbours.knn_probability(
            state.tables["train"], encoding.transform(df), features.ORDINAL, stds, id_col, "target",
            k=params.get("n_neighbors", 15), p=params.get("p", 2),
            weights=params.get("weights", "uniform"),
        )
        return found.select(*df.columns, "probability")

    return score


def gaussian_stats(rows: DataFrame, columns: list[str], by: list[str] | None = None):
    """Count, means and population variances per class, and the largest overall variance."""
    by = list(by or [])
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("v", F.var_pop))]
    classes = settle(rows.groupBy(*by, "target").agg(*aggs))
    widest = rows.groupBy(*by).agg(F.greatest(*[F.var_pop(c) for c in columns]).alias("widest"))
    return classes, settle(widest)


def gaussian_probability(classes: list, widest: float, smoothing: Column,
                         columns: list[str]) -> Column:
    """P(target = 1) from the log ratio of the two class densities."""
    total = sum(c["n"] for c in classes)
    log_joint = {}
    for row in classes:
        joint = F.log(F.lit(row["n"] / total))
        for c in columns:
            var = F.lit(row[f"v_{c}"]) + smoothing * F.lit(widest)
            gap = F.col(c) - F.lit(row[f"m_{c}"])
            joint = joint - F.log(F.lit(6.283185307179586) * var) / 2 - gap * gap / (2 * var)
        log_joint[row["target"]] = joint
    return 1 / (1 + F.exp(log_joint[0] - log_joint[1]))


def gaussian_nb(train: DataFrame, params: dict, seed: int = 0) -> Scorer:
    _refuse("gaussian_nb", params, {"var_smoothing"})
    encoding = features.fit_ordinal(train, scaled=True)
    classes, widest = gaussian_stats(encoding.transform(train), features.SCALED)
    numbers, tables = stored.of_ordinal(encoding)
    numbers |= {"classes": [r.asDict() for r in classes.collect()],
                "widest": widest.first()["widest"],
                "smoothing": float(params.get("var_smoothing", 1e-9))}
    return scorer(State("gaussian_nb", numbers, tables))


def _gaussian_score(state: State):
    encoding, numbers = stored.ordinal(state), state.numbers
    p = gaussian_probability(numbers["classes"], numbers["widest"], F.lit(numbers["smoothing"]),
                             features.SCALED)

    def score(df):
        return encoding.transform(df).withColumn("probability", p).select(
            *df.columns, "probability")

    return score


def mlp(train: DataFrame, params: dict, seed: int, id_col: str = "unit_id") -> Scorer:
    """Network with early stopping on a stratified holdout (M8).

    Training goes on in stages of a few iterations, each from the weights of the one before. The
    log-loss of the holdout after every stage makes a series, which ends by the patience rule of
    the boosted models; the weights of the best stage are the model. ``info`` has the series.
    """
    _refuse("mlp", params, {"hidden_layer_sizes", "max_iter", "early_stopping",
                            "validation_fraction", "n_iter_no_change"})
    hidden = [int(n) for n in params.get("hidden_layer_sizes", (64, 32))]
    limit, patience = int(params.get("max_iter", 250)), int(params.get("n_iter_no_change", 10))
    net = MultilayerPerceptronClassifier(layers=[len(FEATURES), *hidden, 2], seed=seed)
    if not params.get("early_stopping", True):
        transform, numbers, tables = _ordinal(train, scaled=True)
        model = _fit_on(net.setMaxIter(limit), transform(train))
        return scorer(State("mlp", numbers, tables, {"model": model}), {"model": model})
    sides = stopping_sides(train, f"stop{seed}", id_col,
                           float(params.get("validation_fraction", 0.1)), scaled=True)
    _, numbers, tables = sides.encoding
    series, models, at = [], [], 0
    while at < limit:
        length = min(NETWORK_STAGE, limit - at)
        if models:
            net = net.setInitialWeights(models[-1].weights)
        models.append(net.setMaxIter(length).setParams(
            featuresCol="features", labelCol="label").fit(sides.fit))
        at += length
        series.append((at, log_loss(models[-1].transform(sides.check))))
        losses = small_table(train.sparkSession, series, "iteration int, loss double")
        best = patience_stop(losses, patience).first()["best_iteration"]
        if at - best >= patience:
            break
    sides.release()
    model = models[[i for i, _ in series].index(best)]
    return scorer(State("mlp", numbers, tables, {"model": model}),
                  {"model": model, "best_iteration": best, "losses": losses})


def log_loss(scored: DataFrame) -> float:
    """Mean log-loss of ``probability`` (a vector) against ``label``."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), vector_to_array("probability")[1]))
    own = F.when(F.col("label") == 1, p).otherwise(1 - p)
    return float(scored.agg(F.avg(-F.log(own))).first()[0])


# -- linear models -----------------------------------------------------------------------------

def _ridge(rows: int, c: float) -> dict:
    """Spark's mean loss + regParam/2 |w|^2 is the summed loss with 1/C, divided by C n."""
    return {"regParam": 1.0 / (float(c) * rows), "elasticNetParam": 0.0,
            "standardization": False}


def logistic_regression(train: DataFrame, params: dict, seed: int = 0) -> Scorer:
    require_known("logistic_regression", params)
    encoding = features.fit_one_hot(train)
    estimator = LogisticRegression(maxIter=1000, tol=1e-12,
                                   **_ridge(train.count(), params.get("C", 1.0)))
    model = _fit_on(estimator, encoding.transform(train))
    return scorer(State("logistic_regression", *stored.of_one_hot(encoding), {"model": model}),
                  {"model": model, "encoded": encoding.transform})


def linear_svm(train: DataFrame, params: dict, seed: int, id_col: str = "unit_id") -> Scorer:
    """Linear SVM (squared hinge) with sigmoid calibration, averaged over cross-validation folds
    (M10). The planes of the folds are fitted as concurrent jobs, all sigmoids in one batch."""
    require_known("linear_svm", params)
    encoding = features.fit_one_hot(train)
    folds, c = int(params.get("cv", 5)), float(params.get("C", 1.0))
    folded = stage(
        split.stratified_folds(train, folds, f"svm{seed}", id_col), "svm"
    )
    held = encoding.transform(folded).select(
        "fold", "target", "features", F.col("target").cast("double").alias("label")).persist()
    encoded = _gathered(held)
    planes = _pooled(lambda fold: newton.squared_hinge(encoded.where(F.col("fold") != fold), c),
                     list(range(folds)))
    margins = reduce(DataFrame.unionByName, [
        plane.model.transform(newton.augmented(encoded.where(F.col("fold") == fold))).select(
            F.lit(fold).alias("model"), F.col("_f").alias("margin"), "target")
        for fold, plane in enumerate(planes)])
    sigmoids = newton.platt(stage(margins, "margins"), folds)
    held.unpersist()
    models = {f"fold{fold}": plane.model for fold, plane in enumerate(planes)}
    numbers, tables = stored.of_one_hot(encoding)
    numbers |= {"sigmoids": sigmoids.tolist()}
    return scorer(State("linear_svm", numbers, tables, models),
                  {"members": folds, "planes": planes, "encoded": encoding.transform(folded)})


def _svm_score(state: State):
    encoding, sigmoids = stored.one_hot(state), state.numbers["sigmoids"]

    def score(df):
        wide = newton.augmented(encoding.transform(df))
        for i, (slope, intercept) in enumerate(sigmoids):
            model = state.models[f"fold{i}"]
            wide = model.copy({model.featuresCol: "_x", model.predictionCol: f"_f{i}"}).transform(wide)
            wide = wide.withColumn(f"_p{i}", newton.probability(F.col(f"_f{i}") * slope + intercept))
        mean = sum((F.col(f"_p{i}") for i in range(len(sigmoids))), F.lit(0.0)) / len(sigmoids)
        return wide.withColumn("probability", mean).select(*df.columns, "probability")

    return score


# -- stacking ----------------------------------------------------------------------------------

def fold_tables(folded: DataFrame, encodings: list[tuple], columns: list[str],
                parallel: int = PARALLEL, bound: int | None = None,
                make: Callable = lambda x, y, more: grown.table(x, y)) -> tuple[list, list] | None:
    """For every fold the rows outside it as ``make`` lays them out, and its own rows as ``few``
    gives them, by the encoding of the fold; None if the rows are many. ``columns`` contain the
    fold."""
    found = _pooled(lambda encoding: few(encoding[0](folded), *columns, bound=bound), encodings,
                    parallel)
    if not all(found):
        return None
    tables, held = [], []
    for fold, (x, y, more) in enumerate(found):
        own = more["fold"].to_numpy() == fold
        tables.append(make(x[~own], y[~own], more.filter(pa.array(~own))))
        held.append((x[own], y[own], more.filter(pa.array(own))))
    return tables, held


def out_of_fold(folded: DataFrame, specs: dict[str, dict], folds: int, seed: int,
                id_col: str) -> DataFrame:
    """Long out-of-fold scores (id, target, fold, model, probability): one per row and base.

    A fold's encoding is made once for its base models; all fits form one pool, on few rows the
    tasks of one job.
    """
    sides = [(folded.where(F.col("fold") != f), folded.where(F.col("fold") == f))
             for f in range(folds)]
    encodings = _pooled(lambda side: _ordinal(side[0]), sides)
    columns = [id_col, "target", "fold"]
    found = fold_tables(folded, encodings, columns)
    if found:
        fits = [grown.Fit(n, f, boosting_settings(n, specs[n]["params"]),
                          _rounds(specs[n]["params"], specs[n].get("iterations")), seed + f)
                for f in range(folds) for n in BOOSTING]
        scores = held_scores(folded.sparkSession, fits, T.StructField("model", T.StringType()),
                             *found, [folded.schema[c] for c in columns])
        return scores.select(*columns, "model", "probability")

    def one(task: tuple[int, str]) -> DataFrame:
        fold, name = task
        inner, held = sides[fold]
        spec = specs[name]
        fitted = boosting(name)(inner, spec["params"], seed + fold, spec.get("iterations"),
                                encodings[fold])
        return fitted.score(held).select(
            id_col, "target", "fold", F.lit(name).alias("model"), "probability")

    parts = _pooled(one, [(f, n) for f in range(folds) for n in BOOSTING])
    return reduce(DataFrame.unionByName, parts)


def meta_features(long: DataFrame, keys: list[str]) -> DataFrame:
    """One column per base model."""
    return long.groupBy(*keys).pivot("model", BOOSTING).agg(F.first("probability"))


def fit_meta(rows: DataFrame, c: float):
    """Logistic regression on the three base probabilities."""
    vectors = VectorAssembler(inputCols=BOOSTING, outputCol="features").transform(rows)
    model = LogisticRegression(maxIter=1000, **_ridge(rows.count(), c))
    return _fit_on(model, vectors)


def score_meta(model, rows: DataFrame) -> DataFrame:
    vectors = VectorAssembler(inputCols=BOOSTING, outputCol="features").transform(rows)
    p = vector_to_array("probability")[1]
    return model.transform(vectors).withColumn("probability", p).select(
        *rows.columns, "probability")


def stacking(train: DataFrame, params: dict, seed: int, id_col: str = "unit_id",
             specs: dict[str, dict] | None = None) -> Scorer:
    """Out-of-fold base probabilities, a logistic meta-model, bases refitted on all rows."""
    specs = specs or {name: {"params": params.get("base", {}).get(name, {})}
                      for name in BOOSTING}
    folds = int(params.get("folds", 5))
    folded = stage(split.stratified_folds(train, folds, f"stack{seed}", id_col), "stack")
    long = out_of_fold(folded, specs, folds, seed, id_col)
    table = stage(meta_features(long, [id_col, "target", "fold"]), "oof")
    meta = fit_meta(table, params.get("C", 1.0))
    encoded = _ordinal(train)
    fitted = _pooled(lambda n: boosting(n)(
        train, specs[n]["params"], seed, specs[n].get("iterations"), encoded).state, BOOSTING)
    bases = dict(zip(BOOSTING, fitted))
    return scorer(State("stacking", models={"meta": meta}, parts=bases),
                  {"oof": table, "meta": meta})


def _stack_score(state: State):
    bases = {name: scorer(part) for name, part in state.parts.items()}

    def score(df):
        wide = df
        for name in BOOSTING:
            wide = bases[name].score(wide).withColumnRenamed("probability", name)
        return score_meta(state.models["meta"], wide).drop(*BOOSTING)

    return score


SCORES = {
    "random_forest": _forest_score, "boosting": _boosting_score, "mlp": _on_ordinal,
    "logistic_regression": _on_one_hot, "extra_trees": _forest_score, "knn": _knn_score,
    "gaussian_nb": _gaussian_score, "linear_svm": _svm_score, "stacking": _stack_score,
}


# -- registry ----------------------------------------------------------------------------------

# Settings of the two profiles; the full ones are the defaults of the fits above.
FAST = {
    "random_forest": {"n_estimators": 30},
    "extra_trees": {"n_estimators": 30},
    "xgboost": {"n_estimators": 20, "max_depth": 4, "learning_rate": 0.10,
                "subsample": 0.8, "colsample_bytree": 0.8},
    "lightgbm": {"n_estimators": 20, "num_leaves": 15, "learning_rate": 0.10},
    "catboost": {"n_estimators": 20, "depth": 4, "learning_rate": 0.10},
    "mlp": {"hidden_layer_sizes": (32,), "max_iter": 80},
    "linear_svm": {"cv": 3},
}
FULL = {"xgboost": {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.05,
                    "subsample": 0.8, "colsample_bytree": 0.8}}


def defaults(name: str, fast: bool = False) -> dict:
    if name not in NAMES:
        raise ValueError(f"Unknown model {name!r}: known are {NAMES}.")
    profile = FAST if fast else FULL
    if name == "stacking":
        return {"base": {n: profile.get(n, {}) for n in BOOSTING}}
    return dict(profile.get(name, {}))


def fit(name: str, train: DataFrame, params: dict, seed: int, id_col: str = "unit_id",
        iterations: int | None = None, specs: dict[str, dict] | None = None) -> Scorer:
    """Fit a model by name."""
    if name in BOOSTING:
        return boosting(name)(train, params, seed, iterations)
    if name == "stacking":
        return stacking(train, params, seed, id_col, specs)
    if name in ("knn", "linear_svm", "mlp"):
        return {"knn": knn, "linear_svm": linear_svm, "mlp": mlp}[name](train, params, seed, id_col)
    simple = {"random_forest": random_forest, "extra_trees": extra_trees_model,
              "gaussian_nb": gaussian_nb, "logistic_regression": logistic_regression}
    if name not in simple:
        raise ValueError(f"Unknown model {name!r}: known are {NAMES}.")
    return simple[name](train, params, seed)
