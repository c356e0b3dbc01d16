"""Trees grown inside tasks: boosted ensembles with their early stopping, and forests.

A binned tree is Spark's: at most 32 bins per feature, the split of largest variance gain, grown
level by level to a depth. Where the rows of a fit lie in one task anyway, a task goes through all
levels itself, instead of one job for each; a larger table stays with the distributed fits.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctua.operators import extra_trees

# Task functions travel with the job, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BINS = 32
NOISE = 1e-13  # a gain below this share of a node's squares is rounding


def edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds of one feature: all middles between its values, or those that come closest to
    equal counts."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) <= bins - 1:
        return middles
    stride = len(values) / bins
    kept, target = [], stride
    seen = np.cumsum(counts)
    for i in range(1, len(found)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            kept.append(middles[i - 1])
            target += stride
    return np.array(kept)


@dataclass(frozen=True)
class Table:
    """Rows of a fit as bins (feature, row) with a class each (0 or 1), and rows to check."""

    x: np.ndarray
    cuts: list
    bins: np.ndarray
    label: np.ndarray
    check_bins: np.ndarray
    check_label: np.ndarray


def _sorted(x: np.ndarray, y: np.ndarray):
    """Rows in an order of their own, so that draws do not depend on how a table lies in files."""
    at = np.lexsort([y, *x.T])
    return x[at], y[at]


def table(x: np.ndarray, y: np.ndarray, check_x: np.ndarray | None = None,
          check_y: np.ndarray | None = None) -> Table:
    if not len(x):
        raise ValueError("A fit needs rows.")
    none = np.zeros((0, x.shape[1])), np.zeros(0)
    check_x, check_y = none if check_x is None else (check_x, check_y)
    for labels in (y, check_y):
        if not np.isin(labels, (0.0, 1.0)).all():
            raise ValueError("Classes are 0 and 1.")
    x, y = _sorted(x, y)
    cuts = [edges(x[:, f], min(MAX_BINS, len(x))) for f in range(x.shape[1])]

    def binned(rows):
        return np.array([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], np.uint8)

    return Table(x, cuts, binned(x), y, binned(check_x), check_y)


def grow(bins: np.ndarray, y: np.ndarray, inside: int, width: int, depth: int, least: int,
         picked: int, rng) -> tuple[dict, np.ndarray]:
    """(nodes, leaf per row) of a regression tree on the first ``inside`` rows; the others are only
    led through it. A split leaves ``least`` rows on both sides; ``picked`` features are drawn for
    every node."""
    d, rows = bins.shape
    bins = bins.astype(np.int64)
    at, slot, leaf = np.arange(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    response = y[:inside]
    n, s = np.array([float(inside)]), np.array([response.sum()])
    feature, cut, left, value = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.full(1, -1)], [s / n]
    first, nodes = 0, 1  # the open nodes are first, first + 1, ...
    for _ in range(depth):
        m = nodes - first
        own = slot[:inside]
        base = own * width
        count, total = np.empty((m, d, width)), np.empty((m, d, width))
        for f in range(d):
            index = base + bins[f, :inside]
            count[:, f] = np.bincount(index, minlength=m * width).reshape(m, width)
            total[:, f] = np.bincount(index, response, m * width).reshape(m, width)
        count, total = count.cumsum(axis=2)[..., :-1], total.cumsum(axis=2)[..., :-1]
        others = n[:, None, None] - count
        rest = s[:, None, None] - total
        with np.errstate(divide="ignore", invalid="ignore"):
            score = total * total / count + rest * rest / others
        score[(count < least) | (others < least)] = -np.inf
        if picked < d:
            drawn = rng.random((m, d)).argsort(axis=1) < picked
            score[~drawn] = -np.inf
        score = score.reshape(m, -1)
        best = score.argmax(axis=1)
        every = np.arange(m)
        squares = np.bincount(own, response * response, m)
        split = score[every, best] - s * s / n > NOISE * squares
        parents = np.flatnonzero(split)
        if not len(parents):
            break
        best = best[parents]
        by, where = best // (width - 1), best % (width - 1)
        feature[-1][parents], cut[-1][parents] = by, where
        left[-1][parents] = nodes + 2 * np.arange(len(parents))
        low = count.reshape(m, -1)[parents, best], total.reshape(m, -1)[parents, best]
        n = np.column_stack([low[0], n[parents] - low[0]]).ravel()
        s = np.column_stack([low[1], s[parents] - low[1]]).ravel()
        place = np.full(m, -1)
        place[parents] = np.arange(len(parents))
        slot = place[slot]
        stay = slot >= 0
        if not stay.all():
            inside = int(stay[:inside].sum())
            at, slot, bins = at[stay], slot[stay], bins[:, stay]
            response = y[at[:inside]]
        slot = 2 * slot + (bins[by[slot], np.arange(len(slot))] > where[slot])
        first, nodes = nodes, nodes + len(n)
        leaf[at] = first + slot
        for part, empty in ((feature, 0), (cut, 0), (left, -1)):
            part.append(np.full(len(n), empty, np.int64))
        value.append(s / n)
    found = {"feature": feature, "cut": cut, "left": left, "value": value}
    return {k: np.concatenate(v) for k, v in found.items()}, leaf


def boost(rows: Table, settings: dict, rounds: int, seed: int, patience: int | None = None):
    """(trees, best round) of Spark's boosting by log-loss: the first tree is fitted to -1 and 1,
    the others to the slopes of the loss; leaf values of a tree carry its weight.

    With ``patience`` the loss of the rows to check ends the series at the first round that is so
    far past the best one, and the trees up to the best round are the model.
    """
    rng = np.random.default_rng(seed)
    inner, d = len(rows.label), len(rows.cuts)
    bins = np.concatenate([rows.bins, rows.check_bins], axis=1)
    sign = 2.0 * np.concatenate([rows.label, rows.check_label]) - 1.0
    width = max(2, max(len(c) for c in rows.cuts) + 1)
    share, subset = settings["subsamplingRate"], settings["featureSubsetStrategy"]
    picked = d if subset == "all" else ceil(float(subset) * d)
    score, trees, best, least = np.zeros(len(sign)), [], 0, np.inf
    for m in range(rounds):
        with np.errstate(over="ignore"):
            pull = sign if not m else 4.0 * sign / (1.0 + np.exp(2.0 * sign * score))
        order, inside = None, inner
        if share < 1.0:
            drawn = np.concatenate([rng.random(inner) < share, np.zeros(len(sign) - inner, bool)])
            order, inside = np.argsort(~drawn, kind="stable"), int(drawn.sum())
        if not inside:
            raise ValueError("A round drew no rows.")
        tree, leaf = grow(bins if order is None else bins[:, order],
                          pull if order is None else pull[order], inside, width,
                          settings["maxDepth"], settings["minInstancesPerNode"], picked, rng)
        tree["value"] = tree["value"] * (settings["stepSize"] if m else 1.0)
        score[slice(None) if order is None else order] += tree["value"][leaf]
        trees.append(tree)
        if patience is None:
            continue
        loss = 2.0 * np.logaddexp(0.0, -2.0 * sign[inner:] * score[inner:]).sum() / max(
            1, len(sign) - inner)
        if loss < least or not best:
            best, least = m + 1, loss
        if m + 1 - best >= patience:
            break
    best = best or len(trees)
    return _joined(trees[:best], rows.cuts), best


def _joined(trees: list[dict], cuts: list | None = None) -> extra_trees.Trees:
    """Trees one after the other, with thresholds in place of bins."""
    sizes = [len(t["left"]) for t in trees]
    root = np.cumsum([0, *sizes[:-1]])
    left = np.concatenate([np.where(t["left"] >= 0, t["left"] + r, -1) for t, r in zip(trees, root)])
    feature = np.concatenate([t["feature"] for t in trees])
    if cuts is None:
        threshold = np.concatenate([t["threshold"] for t in trees])
    else:
        wide = np.zeros((len(cuts), max(1, max(len(c) for c in cuts))))
        for f, c in enumerate(cuts):
            wide[f, :len(c)] = c
        threshold = np.where(left >= 0, wide[feature, np.concatenate([t["cut"] for t in trees])], 0.0)
    return extra_trees.Trees(root, feature.astype(np.int8), threshold, left.astype(np.int32),
                             np.concatenate([t["value"] for t in trees]))


# -- forests -------------------------------------------------------------------------------------

def _merged(tree: dict) -> dict:
    """Sibling leaves of one majority class become one leaf, as in Spark's forests."""
    left, value = tree["left"], tree["value"]
    while True:
        inner = np.flatnonzero(left >= 0)
        low = left[inner]
        same = (value[low] > 0.5) == (value[low + 1] > 0.5)
        ends = inner[(left[low] < 0) & (left[low + 1] < 0) & same]
        if not len(ends):
            break
        left[ends] = -1
    seen = np.zeros(len(left), bool)  # parents come before their children
    seen[0] = True
    for node in np.flatnonzero(left >= 0):
        if seen[node]:
            seen[left[node]:left[node] + 2] = True
    place = np.cumsum(seen) - 1
    tree["left"] = np.where(left >= 0, place[left], -1)
    return {k: v[seen] for k, v in tree.items()}


def bagged(rows: Table, settings: dict, seed: int, number: int) -> dict:
    """A tree of a random forest on rows drawn with replacement (Poisson, mean 1)."""
    rng, d = np.random.default_rng([seed, number]), len(rows.cuts)
    drawn = np.repeat(np.arange(len(rows.label)), rng.poisson(1.0, len(rows.label)))
    if not len(drawn):
        raise ValueError("A tree drew no rows.")
    width = max(2, max(len(c) for c in rows.cuts) + 1)
    tree, _ = grow(rows.bins[:, drawn], rows.label[drawn], len(drawn), width, settings["depth"],
                   settings["least"], settings["picked"], rng)
    return _merged(tree)


def random_cuts(x: np.ndarray, y: np.ndarray, settings: dict, seed: int, number: int) -> dict:
    """An extremely randomised tree on rows (feature, row): of the features that vary in a node
    some are drawn with one uniform threshold each, and the best Gini gain wins."""
    rng, (d, rows) = np.random.default_rng([seed, number]), x.shape
    least, slot = settings["least"], np.zeros(rows, np.int64)
    n, p = np.array([float(rows)]), np.array([y.sum()])
    feature, threshold, left = [np.zeros(1, np.int64)], [np.zeros(1)], [np.full(1, -1)]
    value, nodes = [p / n], 1
    for _ in range(settings["depth"]):
        m = len(n)
        order = np.argsort(slot, kind="stable")
        start = np.searchsorted(slot[order], np.arange(m))
        low = np.minimum.reduceat(x[:, order], start, axis=1)
        high = np.maximum.reduceat(x[:, order], start, axis=1)
        asked = high > low
        rank = np.where(asked, rng.random((d, m)), 2.0).argsort(axis=0).argsort(axis=0)
        asked &= (rank < settings["picked"]) & (n >= 2 * least) & (p > 0) & (p < n)
        cuts = rng.uniform(low, high)
        score = np.full((d, m), -np.inf)
        sides = np.zeros((2, d, m))
        for f in range(d):
            right = x[f] > cuts[f, slot]
            sides[0, f] = np.bincount(slot[right], minlength=m)
            sides[1, f] = np.bincount(slot[right], y[right], m)
        others, rest = n - sides[0], p - sides[1]
        asked &= (sides[0] >= least) & (others >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sides[1] ** 2 / sides[0] + rest ** 2 / others
        score[asked] = gain[asked]
        best = score.argmax(axis=0)
        parents = np.flatnonzero(asked.any(axis=0))
        if not len(parents):
            break
        best = best[parents]
        feature[-1][parents], threshold[-1][parents] = best, cuts[best, parents]
        left[-1][parents] = nodes + 2 * np.arange(len(parents))
        place = np.full(m, -1)
        place[parents] = np.arange(len(parents))
        n = np.column_stack([others[best, parents], sides[0][best, parents]]).ravel()
        p = np.column_stack([rest[best, parents], sides[1][best, parents]]).ravel()
        cut = cuts[best, parents]
        slot = place[slot]
        stay = slot >= 0
        x, y, slot = x[:, stay], y[stay], slot[stay]
        slot = 2 * slot + (x[best[slot], np.arange(len(slot))] > cut[slot])
        nodes += len(n)
        for part, empty in ((feature, np.zeros(len(n), np.int64)), (threshold, np.zeros(len(n))),
                            (left, np.full(len(n), -1))):
            part.append(empty)
        value.append(p / n)
    found = {"feature": feature, "threshold": threshold, "left": left, "value": value}
    return {k: np.concatenate(v) for k, v in found.items()}


def forest(rows: Table, settings: dict, seed: int, numbers: range) -> extra_trees.Trees:
    """Trees of a forest by number: bagged and binned ones, or extremely randomised ones."""
    if settings["bagged"]:
        return _joined([bagged(rows, settings, seed, i) for i in numbers], rows.cuts)
    x = np.ascontiguousarray(rows.x.T)
    return _joined([random_cuts(x, rows.label, settings, seed, i) for i in numbers])


def combined(parts: list[extra_trees.Trees]) -> extra_trees.Trees:
    """The trees of several parts as one model."""
    starts = np.cumsum([0, *[len(p.left) for p in parts[:-1]]])
    left = [np.where(p.left >= 0, p.left + s, -1).astype(np.int32) for p, s in zip(parts, starts)]
    return extra_trees.Trees(np.concatenate([p.root + s for p, s in zip(parts, starts)]),
                             *[np.concatenate([getattr(p, k) for p in parts])
                               for k in ("feature", "threshold")],
                             np.concatenate(left), np.concatenate([p.value for p in parts]))


def held_share(rows: Table, settings: dict, seed: int, trees: int, x: np.ndarray) -> np.ndarray:
    """P(class 1) of rows by a forest that is not kept."""
    total = np.zeros(len(x))
    for number in range(trees):
        total += shares(forest(rows, settings, seed, range(number, number + 1)), x)
    return total / trees


def shares(trees: extra_trees.Trees, x: np.ndarray) -> np.ndarray:
    """Sum over trees of the positive share in the leaves of rows."""
    return sum((trees.value[trees.leaves(x, t)] for t in range(len(trees.root))), np.zeros(len(x)))


def probability(trees: extra_trees.Trees, x: np.ndarray) -> np.ndarray:
    """P(class 1) of rows by a boosted ensemble."""
    score = np.zeros(len(x))
    for tree in range(len(trees.root)):
        score += trees.value[trees.leaves(x, tree)]
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-2.0 * score))


def predict(trees: extra_trees.Trees, df: DataFrame, column: str) -> DataFrame:
    """Add ``probability`` to rows whose feature values are an array."""

    @F.pandas_udf(T.DoubleType())
    def scored(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=float)
        return pd.Series(probability(trees, np.stack(values.to_numpy())))

    return df.withColumn("probability", scored(F.col(column)))


@dataclass(frozen=True)
class Fit:
    """One of many fits: rounds of boosting, or trees of a forest, on the table of a fold."""

    key: int | str
    fold: int
    settings: dict
    rounds: int
    seed: int
    patience: int | None = None

    @property
    def cost(self) -> tuple:
        return self.settings.get("maxDepth", 0), -self.settings.get("stepSize", 0.0), self.rounds

    def scored(self, rows: Table, x: np.ndarray) -> tuple[np.ndarray, int]:
        """P(class 1) of ``x`` and the best round."""
        if "bagged" in self.settings:
            return held_share(rows, self.settings, self.seed, self.rounds, x), self.rounds
        trees, best = boost(rows, self.settings, self.rounds, self.seed, self.patience)
        return probability(trees, x), best
