"""Exact k nearest neighbours without comparing every pair.

1. Equal feature vectors are one point. Of its training rows only the k lowest ids can ever be
   among the k nearest, so only these stay; test rows are asked once per distinct vector.
2. A k-d tree drawn from a bounded sample cuts the space into cells of about ``LEAF`` points.
   The sample steers the balance alone.
3. Pass one compares a test point with its own cell and gets an upper bound on its k-th
   distance. Pass two visits just the cells whose bounding box is within that bound.
4. The k best per cell are merged per test point.

Order is by (squared or absolute distance rounded to 9 digits, id).
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from punctua.session import settle, stage

# Task functions travel with the job, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF = 512
MAX_CELLS = 65_536
SAMPLE = 200_000
CHUNK = 4_096
SLACK = 1e-7
DIGITS = 9


def _tree(points: np.ndarray, cells: int) -> list[tuple]:
    """Splits (dimension, threshold, left, right) in preorder; a leaf is (-1, 0, cell, 0)."""
    nodes: list = []
    leaves = 0

    def grow(rows: np.ndarray, budget: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(None)
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
        axis = int(spread.argmax())
        if budget < 2 or len(rows) < 2 or spread[axis] <= 0:
            nodes[at] = (-1, 0.0, leaves, 0)
            leaves += 1
            return at
        values = rows[:, axis]
        cut = float(np.median(values))
        if not (values > cut).any():
            cut = float(values[values < cut].max())
        left = grow(rows[values <= cut], budget // 2)
        right = grow(rows[values > cut], budget - budget // 2)
        nodes[at] = (axis, cut, left, right)
        return at

    grow(points, max(1, cells))
    return nodes


def _descend(nodes: list, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int32)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        axis, cut, left, right = nodes[at]
        if axis < 0:
            out[rows] = left
            continue
        low = points[rows, axis] <= cut
        todo += [(left, rows[low]), (right, rows[~low])]
    return out


def _distances(a: np.ndarray, b: np.ndarray, scale: np.ndarray, p: int) -> np.ndarray:
    """Scaled distance (absolute for p=1, squared for p=2), summed in column order."""
    total = np.zeros((len(a), len(b)))
    for j, s in enumerate(scale):
        gap = np.abs(a[:, j][:, None] - b[:, j][None, :]) / s
        total += gap if p == 1 else gap * gap
    return np.round(total, DIGITS)


def _box_hits(nodes: list, low: np.ndarray, high: np.ndarray, points: np.ndarray,
              reach: np.ndarray, scale: np.ndarray, p: int) -> list[list[int]]:
    """Cells whose box is within reach of each point, found by walking the tree once."""
    hits: list[list[int]] = [[] for _ in range(len(points))]
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        gap = np.maximum(0.0, np.maximum(low[at] - points[rows], points[rows] - high[at])) / scale
        away = gap.sum(axis=1) if p == 1 else (gap * gap).sum(axis=1)
        rows = rows[away <= reach[rows]]
        if not len(rows):
            continue
        axis, _, left, right = nodes[at]
        if axis < 0:
            for r in rows:
                hits[r].append(int(left))
        else:
            todo += [(left, rows), (right, rows)]
    return hits


def _node_boxes(nodes: list, boxes: pd.DataFrame, columns: list[str]):
    """Boxes of all nodes from the exact boxes of the cells; an empty cell reaches nothing."""
    low = np.full((len(nodes), len(columns)), np.inf)
    high = np.full((len(nodes), len(columns)), -np.inf)
    leaf_at = {n[2]: i for i, n in enumerate(nodes) if n[0] < 0}
    for row in boxes.itertuples(index=False):
        at = leaf_at[row.cell]
        low[at] = [getattr(row, f"lo_{c}") for c in columns]
        high[at] = [getattr(row, f"hi_{c}") for c in columns]
    count = np.zeros(len(nodes), dtype=np.int64)
    for row in boxes.itertuples(index=False):
        count[leaf_at[row.cell]] = row.rows
    for at in reversed(range(len(nodes))):
        axis, _, left, right = nodes[at]
        if axis >= 0:
            low[at] = np.minimum(low[left], low[right])
            high[at] = np.maximum(high[left], high[right])
            count[at] = count[left] + count[right]
    return low, high, count


def _far_sides(nodes: list, low: np.ndarray, high: np.ndarray, count: np.ndarray,
               points: np.ndarray, k: int, scale: np.ndarray, p: int) -> np.ndarray:
    """A bound of the k-th distance of each point: the far side of the smallest box on its way
    down the tree that holds at least k training points."""
    out = np.zeros(len(points))
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        axis, cut, left, right = nodes[at]
        stay = np.ones(len(rows), dtype=bool)
        if axis >= 0:
            down = points[rows, axis] <= cut
            for child, own in ((left, down), (right, ~down)):
                if count[child] >= k:
                    todo.append((child, rows[own]))
                    stay &= ~own
        rows = rows[stay]
        gap = np.maximum(np.abs(points[rows] - low[at]), np.abs(points[rows] - high[at])) / scale
        out[rows] = (gap.sum(axis=1) if p == 1 else (gap * gap).sum(axis=1)) + SLACK
    return out


def _best(queries: pd.DataFrame, block: pd.DataFrame, columns, scale, k: int, p: int):
    """Per block of test rows: (first row, positions of the k nearest, their distances).

    The block is in id order, so a stable sort breaks ties by id.
    """
    scale = np.asarray(scale)
    a, b = queries[columns].to_numpy(float), block[columns].to_numpy(float)
    for start in range(0, len(a), 256):
        d = _distances(a[start:start + 256], b, scale, p)
        take = np.argsort(d, axis=1, kind="stable")[:, :k]
        yield start, take, np.take_along_axis(d, take, axis=1)


def knn_probability(train: DataFrame, test: DataFrame, columns: list[str], scale: list[float],
                    id_col: str, target: str, k: int = 15, p: int = 2,
                    weights: str = "uniform") -> DataFrame:
    """Add ``probability``: the (weighted) positive share among the k nearest training rows.

    ``scale`` divides each column. With distance weights a zero distance outvotes all others.
    """
    if p not in (1, 2) or weights not in ("uniform", "distance"):
        raise ValueError("kNN knows p 1 or 2 and uniform or distance weights.")
    points = stage(
        train.select(F.col(id_col).alias("tid"), *columns, F.col(target).alias("y"))
        # A rank filter of this form is applied before the shuffle as well, so a hot vector
        # leaves each map task with at most k rows.
        .withColumn("_r", F.row_number().over(W.partitionBy(*columns).orderBy("tid")))
        .where(F.col("_r") <= k).drop("_r"), "points",
    )
    total = points.count()
    if total < k:
        raise ValueError("Fewer training rows than neighbours.")
    sample = points.select(*columns).sample(min(1.0, SAMPLE / max(total, 1)), seed=7).limit(
        SAMPLE).toPandas().to_numpy(float)
    nodes = _tree(sample, min(MAX_CELLS, -(-total // LEAF)))

    @F.pandas_udf(T.IntegerType())
    def cell_of(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(_descend(nodes, frame.to_numpy(float)))

    struct = F.struct(*columns)
    points = stage(points.withColumn("cell", cell_of(struct)), "cells")
    asked = stage(
        test.select(*columns).distinct()
        .withColumn("cell", cell_of(struct)), "asked",
    )
    boxes = settle(points.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.min(c).alias(f"lo_{c}") for c in columns],
        *[F.max(c).alias(f"hi_{c}") for c in columns],
    ))
    low, high, count = _node_boxes(nodes, boxes.toPandas(), columns)

    # Pass one: the k-th distance inside the own cell bounds the true one. Where a cell has fewer
    # than k points, the far side of a larger box does.
    bound_schema = T.StructType(
        [T.StructField(c, T.DoubleType()) for c in [*columns, "reach"]]
    )

    def own_cell(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        reach = np.full(len(queries), np.inf)
        if len(block) >= k:
            for start, _, d in _best(queries, block, columns, scale, k, p):
                reach[start:start + len(d)] = d[:, -1] + SLACK
        return queries[columns].assign(reach=reach)

    bounded = _per_cell(asked, points, own_cell, bound_schema)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells_near(frame: pd.DataFrame, reach: pd.Series) -> pd.Series:
        asked, limit = frame.to_numpy(float), reach.to_numpy(float).copy()
        open_ = np.isinf(limit)
        limit[open_] = _far_sides(nodes, low, high, count, asked[open_], k, np.asarray(scale), p)
        return pd.Series(_box_hits(nodes, low, high, asked, limit, np.asarray(scale), p))

    visits = stage(
        bounded.withColumn("cell", F.explode(cells_near(struct, "reach"))).drop("reach"), "visits"
    )

    # Pass two: the k best of every visited cell, merged per test point.
    near_schema = T.StructType(
        [T.StructField(c, T.DoubleType()) for c in columns]
        + [T.StructField("tid", T.LongType()), T.StructField("y", T.IntegerType()),
           T.StructField("d", T.DoubleType())]
    )

    def nearest(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({f.name: [] for f in near_schema.fields})
        block = block.sort_values("tid")
        parts = []
        for start, take, d in _best(queries, block, columns, scale, k, p):
            near = block[["tid", "y"]].iloc[take.ravel()].assign(d=d.ravel())
            who = queries[columns].iloc[start:start + len(d)]
            who = who.iloc[np.repeat(np.arange(len(d)), take.shape[1])]
            parts.append(pd.concat([who.reset_index(drop=True), near.reset_index(drop=True)],
                                   axis=1))
        return pd.concat(parts)

    merged = _per_cell(visits, points, nearest, near_schema).withColumn(
        "_r", F.row_number().over(W.partitionBy(*columns).orderBy("d", "tid"))
    ).where(F.col("_r") <= k)
    if weights == "uniform":
        vote = F.avg("y")
    else:
        gap = F.col("d") if p == 1 else F.sqrt("d")
        pull = F.when(F.col("d") > 0, 1 / F.when(F.col("d") > 0, gap))
        zero = F.col("d") == 0
        vote = F.when(
            F.count_if(zero) > 0,
            F.avg(F.when(zero, F.col("y").cast("double"))),
        ).otherwise(F.sum(pull * F.col("y")) / F.sum(pull))
    found = merged.groupBy(*columns).agg(vote.alias("probability"))
    return test.join(found, columns, "left")


def _per_cell(queries: DataFrame, points: DataFrame, function, schema) -> DataFrame:
    """Run ``function`` on blocks of (at most about CHUNK) queries with their whole cell.

    A cell that many queries visit is spread over several blocks, and its points are copied to
    each of them; points per cell are bounded by the tree, so no block grows with a hot cell.
    """
    spread = F.pmod(F.xxhash64(*[c for c in queries.columns if c != "cell"]), F.col("_n"))
    blocks = settle(queries.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_n")))
    left = queries.join(blocks, "cell").withColumn("_b", spread.cast("int")).drop("_n")
    right = points.join(blocks, "cell").withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return left.groupBy("cell", "_b").cogroup(right.groupBy("cell", "_b")).applyInPandas(
        lambda q, t: function(q, t) if len(q) else pd.DataFrame(
            {f.name: [] for f in schema.fields}), schema)
