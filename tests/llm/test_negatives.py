"""Hard negatives against a plain search, and the bounds of windows."""

import math
import random

import numpy as np
import pytest
from punctua.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, slot int, whole binary"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], SCHEMA).repartition(3)


def plain(rows, every, positives=5, negatives=5):
    rows = [(i, v, k) for i, v, k in rows if None not in (i, v, k) and v
            and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in rows]
    n = min(lengths, key=lambda x: (-lengths.count(x), x)) if rows else 0
    own = {(i, k, tuple(math.floor(256 * float(np.float32(x))) for x in v))
           for i, v, k in rows if len(v) == n}
    out = []
    for a in own:
        if a[0] % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in own if r != a))
        for p in [s for s in scored if s[2] == a[1]][:positives]:
            fits = [s for s in scored if s[2] != a[1] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]]
            out += [(a[0], p[1], rank, s[1], -p[0], -s[0]) for rank, s in enumerate(fits[:negatives], 1)]
    return sorted(out)


def some_rows(seed, clusters=6, count=300, size=7, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(clusters)]
    rows = []
    for i in range(count):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, spread) for x in c], rng.choice([0, 0, 1, 2, 7])))
    rows += [(1000 + i, [0.5] * size, i % 3) for i in range(30)]  # copies under many ids
    rows += [rows[10]] * 40 + [(10, [0.25] * size, 1), (20, [0.25] * size, 0), (20, [-0.25] * size, 0)]
    rows += [(2000, [0.0] * size, 1), (2010, None, 1), (2020, [0.1] * size, None),
             (None, [0.1] * size, 1), (2030, [float("nan")] + [0.1] * (size - 1), 1),
             (2040, [None] + [0.1] * (size - 1), 1), (2050, [float("inf")] + [0.1] * (size - 1), 1),
             (2060, [0.1] * (size - 1), 1), (2070, [], 1), (2080, [9.0] * size, 50)]
    return rows


@pytest.mark.parametrize("seed, window, pack, anchors", [(1, 256, 4096, 16384), (2, 5, 20, 13)])
def test_negatives_equal_a_plain_search(spark, monkeypatch, seed, window, pack, anchors):
    for name, value in (("WINDOW", window), ("PACK", pack), ("ANCHORS", anchors)):
        monkeypatch.setattr(negatives, name, value)
    rows = some_rows(seed)
    got = negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                           "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 10)


def test_negatives_of_few_rows(spark):
    assert negatives.mine(table(spark, [(1, None, 1)]), F.col("vec_id") % 10 == 0).count() == 0
    one = table(spark, [(0, [0.5, 0.5], 1)])
    assert negatives.mine(one, F.col("vec_id") % 10 == 0).count() == 0  # no positive
    two = table(spark, [(0, [0.5, 0.5], 1), (1, [0.5, 0.25], 1), (2, [0.5, 0.25], 2), (3, [0.5, 0.2], 2)])
    got = negatives.mine(two, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2, 24576, 24576), (0, 1, 2, 3, 24576, 22912)]
    with pytest.raises(Exception, match="too large|2\\^53"):
        negatives.mine(table(spark, [(0, [1e30], 1), (1, [1e30], 1)]), F.col("vec_id") == 0).count()


def scan_of(rng, same, clustered):
    centres = rng.normal(size=(8, 16)) * 100
    v = np.floor(centres[np.repeat(np.arange(8), 64)] + rng.normal(size=(512, 16)) * (5 if clustered else 300))
    refs = negatives.references(v)
    n = 32
    whole = v[rng.permutation(512)[:n]]
    low = np.full((n, 1), 0.0 if same else 50_000.0)
    block = negatives.Block(np.arange(n) + 10_000, np.zeros(n, "<u8"), np.ones(n, int),
                            negatives.narrow(whole), low, np.full((n, 1), 1e9), same)
    return negatives.Scan(block, refs, 5), v, refs


@pytest.mark.parametrize("clustered", [True, False])
def test_score_bounds_hold_and_skip_windows(clustered):
    rng = np.random.default_rng(5)
    scan, v, refs = scan_of(rng, True, clustered)
    for s in range(0, 512, 64):
        part = v[s:s + 64]
        found, norms = negatives.angles(part, refs)
        lower, upper = scan.interval(np.arange(32), found.min(axis=0).astype("f4"),
                                     found.max(axis=0).astype("f4"), norms.min(), norms.max())
        scores = scan.v @ part.T
        assert (scores.min(axis=1) >= lower).all() and (scores.max(axis=1) <= upper).all()
        scan.overlapping(np.arange(32), found.min(axis=0).astype("f4"),
                         found.max(axis=0).astype("f4"), norms.min(), norms.max())
    if clustered:  # most windows of other clusters are never scored
        assert scan.scored < 0.8 * scan.windows
