"""Newton fits whose sums over rows are grouped aggregates: many logistic models at once, and the
squared-hinge plane by active sets.

No step collects rows: a logistic step is one job for all models together, a hinge step a ridge
regression on the active rows and one job that weighs it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = [1.0 / 2 ** k for k in range(8)]  # shares of a hinge step that are weighed together


# -- logistic models -----------------------------------------------------------------------------

def _listed(values: np.ndarray) -> Column:
    """Coefficients as one literal, so that the plan of every step is the same code."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in values])


def logits(columns: list[str], weights: np.ndarray, model: Column) -> Column:
    """Intercept and slopes of the given model, applied to a row; ``model`` counts from 0."""
    own = F.get(_listed(weights), model)
    terms = [F.col(c) * F.get(own, F.lit(j)) for j, c in enumerate(columns)]
    return sum(terms, F.get(own, F.lit(len(columns))))


def probability(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logistic_fits(rows: DataFrame, columns: list[str], target: Column, members: Column,
                  ridges: list[float], tol: float = 1e-10, steps: int = 60) -> np.ndarray:
    """Coefficients, one row per model: a slope for each column, then the intercept.

    ``members`` is an array with the numbers of the models that a row belongs to; ``target`` is a
    probability. Model m minimises its summed log-loss plus ridges[m] / 2 times the squared slopes.
    Each step is one job for all models; a step that raises a model's loss is halved. A model
    without rows keeps zeros.
    """
    d, n = len(columns) + 1, len(ridges)
    x = [*[F.col(c) for c in columns], F.lit(1.0)]
    long = rows.select(*columns, target.cast("double").alias("_y"), F.explode(members).alias("_m"))
    penalty = np.array([[r] * (d - 1) + [0.0] for r in ridges])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def sums(weights: np.ndarray):
        z = logits(columns, weights, F.col("_m"))
        table = long.select("*", z.alias("_z")).withColumn("_p", probability(F.col("_z")))
        softplus = F.greatest("_z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z")))
        spread = F.col("_p") * (1 - F.col("_p"))
        found = table.groupBy("_m").agg(
            F.sum(softplus - F.col("_y") * F.col("_z")).alias("loss"),
            *[F.sum((F.col("_p") - F.col("_y")) * x[i]).alias(f"g{i}") for i in range(d)],
            *[F.sum(spread * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs])
        loss, g, h = np.zeros(n), np.zeros((n, d)), np.zeros((n, d, d))
        for r in found.collect():  # one row for each model
            m = r["_m"]
            loss[m], g[m] = r["loss"], [r[f"g{i}"] for i in range(d)]
            for i, j in pairs:
                h[m, i, j] = h[m, j, i] = r[f"h{i}_{j}"]
        return (loss + (penalty * weights ** 2).sum(axis=1) / 2, g + penalty * weights,
                h + penalty[:, :, None] * np.eye(d))

    best, step = np.zeros((n, d)), np.zeros((n, d))
    least = np.full(n, np.inf)
    for _ in range(steps):
        loss, g, h = sums(best + step)
        better = loss <= least + 1e-12 * np.abs(least)
        best[better] += step[better]
        least = np.where(better, loss, least)
        for m in range(n):
            step[m] = -np.linalg.lstsq(h[m], g[m], rcond=None)[0] if better[m] else step[m] / 2
        if np.abs(step).max() < tol * max(1.0, np.abs(best).max()):
            break
    return best


def platt(margins: DataFrame, models: int) -> np.ndarray:
    """(slope, intercept) per model on (model, margin, target), with smoothed targets.

    All sigmoids are fitted together.
    """
    counts = {r["model"]: (r["p"], r["n"]) for r in margins.groupBy("model").agg(
        F.sum("target").alias("p"), F.sum(1 - F.col("target")).alias("n")).collect()}
    soft = F.array(*[F.array(F.lit(1.0 / (n + 2)), F.lit((p + 1.0) / (p + 2)))
                     for p, n in (counts.get(m, (0, 0)) for m in range(models))])
    target = F.get(F.get(soft, F.col("model")), F.col("target").cast("int"))
    return logistic_fits(margins, ["margin"], target, F.array("model"), [0.0] * models)


# -- squared hinge -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Plane:
    """``model`` predicts the signed distance on augmented vectors (``augmented``)."""

    model: LinearRegressionModel
    steps: int

    @property
    def weights(self) -> np.ndarray:
        """Slopes, then the intercept."""
        return self.model.coefficients.toArray()


def augmented(df: DataFrame, out: str = "_x") -> DataFrame:
    """The vectors with a last component of one, whose weight is the intercept."""
    wide = df.withColumn("_one", F.lit(1.0))
    return VectorAssembler(inputCols=["features", "_one"], outputCol=out).transform(wide).drop("_one")


def _ridge(rows: DataFrame, count: int, c: float) -> LinearRegressionModel:
    """The plane of least c * sum (y - wx)^2 + w^2 / 2 over (_x, _y).

    Every row is entered as (x, y) and as (-x, -y), which have the same residual: so neither the
    column of ones nor the label is ever constant, as Spark would leave such a column out.
    """
    size = rows.first()["_x"].size
    turn = ElementwiseProduct(scalingVec=Vectors.dense([-1.0] * size), inputCol="_x", outputCol="_t")
    both = rows.union(turn.transform(rows).select(F.col("_t").alias("_x"), -F.col("_y")))
    fit = LinearRegression(
        featuresCol="_x", labelCol="_y", fitIntercept=False, standardization=False,
        elasticNetParam=0.0, regParam=1.0 / (2.0 * c * count), maxIter=1000, tol=1e-12)
    return fit.fit(both)


def squared_hinge(rows: DataFrame, c: float, max_steps: int = 100) -> Plane:
    """The linear support vector machine with squared hinge loss: least
    w^2 / 2 + c * sum max(0, 1 - y wx)^2, the intercept being a weight like the others.

    ``rows`` has ``features`` and ``label`` (0 or 1). Each step solves the ridge regression on the
    rows inside the margin. When no row enters or leaves the margin the solution is exact;
    until then the step is shortened to the best of a few shares.
    """
    held = augmented(rows).select("_x", (2.0 * F.col("label") - 1.0).alias("_y")).persist()
    try:
        weights, margin = np.zeros(1), F.lit(0.0)
        table = held.withColumn("_m", margin)
        for step in range(1, max_steps + 1):
            active = table.where("_m < 1").select("_x", "_y")
            seen = active.count()
            if not seen:
                raise ValueError("A squared-hinge fit needs rows.")
            model = _ridge(active, seen, c)
            new = model.coefficients.toArray()
            old = np.zeros_like(new) if step == 1 else weights
            model = model.copy({model.featuresCol: "_x", model.predictionCol: "_f"})
            tried = model.transform(table).withColumn("_n", F.col("_y") * F.col("_f")).drop("_f")
            losses = []
            for k, t in enumerate(STEPS):
                gap = F.greatest(1 - (F.col("_m") + t * (F.col("_n") - F.col("_m"))), F.lit(0.0))
                losses.append(F.sum(gap * gap).alias(f"l{k}"))
            found = tried.agg(F.count_if((F.col("_n") < 1) != (F.col("_m") < 1)).alias("moved"),
                              *losses).first()
            costs = [c * found[f"l{k}"] + ((old + t * (new - old)) ** 2).sum() / 2
                     for k, t in enumerate(STEPS)]
            share = STEPS[int(np.argmin(costs))]
            if not found["moved"] or (share == 1.0 and np.allclose(new, old, rtol=1e-12, atol=1e-14)):
                return Plane(model, step)
            weights = old + share * (new - old)
            if share == 1.0:  # the margins are those of this plane alone
                table = model.transform(held).withColumn("_m", F.col("_y") * F.col("_f")).drop("_f")
            else:
                table = tried.withColumn(
                    "_m", F.col("_m") + share * (F.col("_n") - F.col("_m"))).drop("_n")
        raise RuntimeError(f"The rows inside the margin still change after {max_steps} steps.")
    finally:
        held.unpersist()


def hinge_gradient(rows: DataFrame, plane: Plane, c: float) -> DataFrame:
    """(slot, gradient) of the squared-hinge objective at ``plane``, one row per weight."""
    wide = augmented(rows).withColumn("_y", 2.0 * F.col("label") - 1.0)
    model = plane.model.copy({plane.model.featuresCol: "_x", plane.model.predictionCol: "_f"})
    inside = model.transform(wide).where("_y * _f < 1").select(
        F.posexplode(vector_to_array("_x")).alias("slot", "x"),
        (-2.0 * c * F.col("_y") * (1 - F.col("_y") * F.col("_f"))).alias("pull"))
    sums = inside.where("x <> 0").groupBy("slot").agg(F.sum(F.col("x") * F.col("pull")).alias("pull"))
    listed = F.array(*[F.lit(float(w)) for w in plane.weights])
    every = rows.sparkSession.range(1).select(F.posexplode(listed).alias("slot", "weight"))
    return every.join(sums, "slot", "left").select(
        "slot", (F.col("weight") + F.coalesce("pull", F.lit(0.0))).alias("gradient"))
