"""Extremely randomised trees, grown level by level (M2).

All trees grow together. One level is one pass over the training table: class counts and
feature ranges on both sides of the thresholds drawn for every open node. Tasks hold only the
trees so far and return sums per (node, draw, side); Spark adds these up. The driver keeps the
model: a fit whose trees outgrow ``MAX_NODES`` is refused and needs a lower depth or larger
leaves.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Task functions travel with the job, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_NODES = 5_000_000


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; ``left`` is -1 at a leaf, right is left + 1."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        at = np.full(len(x), self.root[tree])
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return at
            rows = np.flatnonzero(inner)
            here = at[rows]
            high = x[rows, self.feature[here]] > self.threshold[here]
            at[rows] = self.left[here] + high


def _feature_count(max_features, features: int) -> int:
    if max_features == "sqrt":
        return max(1, int(sqrt(features)))
    return max(1, int(float(max_features) * features))


def fit(df: DataFrame, columns: list[str], target: str, trees: int = 300, max_depth: int = 30,
        min_leaf: int = 1, max_features="sqrt", seed: int = 42) -> Trees:
    """No bootstrap; per node a random feature subset with one uniform threshold each; the
    best Gini gain wins."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns],
                     F.col(target).cast("double").alias("_y")).persist()
    try:
        return _grow(rows, columns, trees, max_depth, min_leaf, max_features, seed)
    finally:
        rows.unpersist()


def _grow(rows, columns, trees, max_depth, min_leaf, max_features, seed) -> Trees:
    rng = np.random.default_rng(seed)
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p"),
                     F.array(*[F.min(c) for c in columns]).alias("lo"),
                     F.array(*[F.max(c) for c in columns]).alias("hi")).first()
    share = first["p"] / first["n"]
    model = Trees(np.arange(trees), np.zeros(trees, int), np.zeros(trees),
                  np.full(trees, -1), np.full(trees, share))
    root = (first["n"], first["p"], np.array(first["lo"]), np.array(first["hi"]))
    open_nodes = {node: (node, root) for node in range(trees)}  # node -> (tree, statistics)
    picked = _feature_count(max_features, len(columns))
    for _ in range(max_depth):
        draws, live = {}, set()
        for node, (tree, (n, p, low, high)) in sorted(open_nodes.items()):
            varied = np.flatnonzero(high > low)
            if n < 2 * min_leaf or not 0 < p < n or not len(varied):
                continue
            draws[node] = [(int(f), float(rng.uniform(low[f], high[f])))
                           for f in rng.permutation(varied)[:picked]]
            live.add(tree)
        best = _best_splits(rows, columns, model, draws, sorted(live), min_leaf) if draws else {}
        if not best:
            break
        opened, values = {}, []
        for node, (f, cut, sides) in sorted(best.items()):
            at = len(model.left) + len(values)
            model.feature[node], model.threshold[node], model.left[node] = f, cut, at
            for i, side in enumerate(sides):
                opened[at + i] = (open_nodes[node][0], side)
                values.append(side[1] / side[0])
        if len(model.left) + len(values) > MAX_NODES:
            raise ValueError("The trees outgrow the driver: lower max_depth or raise min_leaf.")
        more = len(values)
        model.feature = np.append(model.feature, np.zeros(more, int))
        model.threshold = np.append(model.threshold, np.zeros(more))
        model.left = np.append(model.left, np.full(more, -1))
        model.value = np.append(model.value, values)
        open_nodes = opened
    return model


def _impurity(n, p):
    return 2 * p * (n - p) / n


def _best_splits(rows, columns, model, draws, live, min_leaf) -> dict:
    """Per node the draw of largest Gini gain: (feature, cut, (left, right) statistics)."""
    width = max(len(v) for v in draws.values())
    feature = np.zeros((len(model.left), width), int)
    cuts = np.full((len(model.left), width), np.nan)
    for node, entries in draws.items():
        for j, (f, cut) in enumerate(entries):
            feature[node, j], cuts[node, j] = f, cut

    def scan(batches):
        sums: dict = {}
        for batch in batches:
            x, y = batch[columns].to_numpy(float), batch["_y"].to_numpy(float)
            for tree in live:
                at = model.leaves(x, tree)
                for j in range(width):
                    cut = cuts[at, j]
                    drawn = np.flatnonzero(~np.isnan(cut))
                    node = at[drawn]
                    right = x[drawn, feature[node, j]] > cut[drawn]
                    key = node * 2 + right
                    order = np.argsort(key, kind="stable")
                    keys, start = np.unique(key[order], return_index=True)
                    if not len(keys):
                        continue
                    picked = drawn[order]
                    size = np.diff(np.append(start, len(order)))
                    hits = np.add.reduceat(y[picked], start)
                    low = np.minimum.reduceat(x[picked], start, axis=0)
                    high = np.maximum.reduceat(x[picked], start, axis=0)
                    for i, k in enumerate(keys):
                        old = sums.get((int(k), j))
                        new = (size[i], hits[i], low[i], high[i])
                        sums[int(k), j] = new if old is None else (
                            old[0] + new[0], old[1] + new[1],
                            np.minimum(old[2], new[2]), np.maximum(old[3], new[3]))
        if sums:
            yield pd.DataFrame({
                "side": [k for k, _ in sums], "j": [j for _, j in sums],
                "n": [float(v[0]) for v in sums.values()],
                "p": [float(v[1]) for v in sums.values()],
                "lo": [v[2].tolist() for v in sums.values()],
                "hi": [v[3].tolist() for v in sums.values()],
            })

    found = rows.mapInPandas(
        scan, "side long, j int, n double, p double, lo array<double>, hi array<double>")
    size = range(len(columns))
    table = found.groupBy("side", "j").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"),
        F.array(*[F.min(F.col("lo")[i]) for i in size]).alias("lo"),
        F.array(*[F.max(F.col("hi")[i]) for i in size]).alias("hi"),
    ).toPandas()
    sides: dict = {}
    for row in table.itertuples(index=False):
        sides.setdefault((row.side // 2, row.j), {})[row.side % 2] = (
            row.n, row.p, np.asarray(row.lo, float), np.asarray(row.hi, float))
    best: dict = {}
    for (node, j), pair in sorted(sides.items()):
        if len(pair) < 2 or min(pair[0][0], pair[1][0]) < min_leaf:
            continue
        n, p = pair[0][0] + pair[1][0], pair[0][1] + pair[1][1]
        gain = _impurity(n, p) - sum(_impurity(*pair[i][:2]) for i in (0, 1))
        if node not in best or gain > best[node][0]:
            best[node] = (gain, (int(feature[node, j]), float(cuts[node, j]),
                                 (pair[0], pair[1])))
    return {node: split for node, (_, split) in best.items()}


def predict(model: Trees, df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``probability``: the mean positive share of the leaves."""

    @F.pandas_udf(T.DoubleType())
    def mean_leaf(frame: pd.DataFrame) -> pd.Series:
        x = frame.to_numpy(float)
        total = np.zeros(len(x))
        for tree in range(len(model.root)):
            total += model.value[model.leaves(x, tree)]
        return pd.Series(total / len(model.root))

    return df.withColumn(
        "probability", mean_leaf(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]))
    )
