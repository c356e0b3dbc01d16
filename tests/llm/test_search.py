"""Licences, neighbours, packing and decontamination."""

import collections

import numpy as np
import pytest
from llm_brute import contained, empty, frame, ordered, some_rows
from punctua.llm import decontaminate, licences, neighbours, packing
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_licence_places(spark):
    rows = [(1, None), (2, ""), (3, "CC BY, cc-by! cc x by"), (4, "All rights reserved. General Public\nLicense"),
            (None, "Licensed under the Apache License, Version 2.0"), (4, "the GNU General Public License, version 3"),
            (6, "word " * 60000 + "cc by"), (7, "license license general public"), (8, "é cc by-nc")]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
           for r in licences.scan(frame(spark, rows)).collect()}
    assert got == {
        (1, 0, 0, None, None, "", ""), (2, 0, 0, None, None, "", ""),
        (3, 7, 2, 0, 2, "cc-by", "cc-by"), (4, 6, 2, 0, 3, "gpl,reserved", "gpl,reserved"),
        (None, 8, 0, None, None, "", "apache-2.0"), (4, 7, 1, 2, 2, "gpl", "gpl,gpl-3.0"),
        (6, 60002, 1, 60000, 60000, "cc-by", "cc-by"), (7, 4, 0, None, None, "", ""),
        (8, 4, 1, 1, 1, "cc-by", "cc-by,cc-by-nc")}
    assert licences.scan(empty(frame(spark, rows))).count() == 0


def test_licences_run_no_python(spark):
    plan = licences.op4_licences(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def vectors_of(spark, x, ids=None):
    rows = [(int(i), [float(a) for a in v], None) for i, v in zip(ids or range(len(x)), x)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")


@pytest.mark.parametrize("scaled", [False, True])
def test_neighbours_recall(spark, scaled):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24)) + 2 * rng.standard_normal((8, 24))[rng.integers(0, 8, 1500)]
    if scaled:
        x *= rng.uniform(0.5, 2, (1500, 1))
    x = x.astype(np.float32).astype(float)
    got = neighbours.search(vectors_of(spark, x), vectors_of(spark, x[:60]), rerank=300,
                            shard_rows=400, block_rows=25, bits=24, substrings=3).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(60):
        s = x @ x[q]
        best = [v for v in np.lexsort((np.arange(1500), -s)) if v != q][:20]
        hit += len({v for v, _ in by[q]} & set(best))
        assert all(abs(score - s[v]) < 1e-9 for v, score in by[q])
        assert [score for _, score in by[q]] == sorted((score for _, score in by[q]), reverse=True)
    assert hit / (60 * 20) >= 0.9


def test_neighbours_defined_cases(spark):
    rows = [(0, [1.0, 0.0], "a"), (20, [1.0, 0.0], "a"), (3, [1.0, 0.0], "a"), (4, [0.0, 1.0], None),
            (5, [0.0, 0.0], "a"), (6, None, "a"), (7, [1.0, None], "a"), (8, [float("nan"), 1.0], "a"),
            (9, [float("inf"), 1.0], "a"), (10, [1.0], "a"), (11, [], "a"), (None, [1.0, 1.0], "a"),
            (40, [0.0, 0.0], "a")]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string")
    got = [tuple(r) for r in neighbours.search(v, v.where("vec_id % 20 = 0")).orderBy(
        "query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 1.0), (0, 3, 4, 0.0),
                   (20, 1, 0, 1.0), (20, 2, 3, 1.0), (20, 3, 4, 0.0)]
    assert neighbours.search(empty(v), v).count() == 0
    assert neighbours.search(v, empty(v)).count() == 0


def test_repeated_queries_and_rows_count_once(spark):
    x = np.random.default_rng(3).standard_normal((60, 8))
    few, many = vectors_of(spark, x), vectors_of(
        spark, np.repeat(x, 3, 0), np.repeat(range(60), 3).tolist())
    asked = vectors_of(spark, x[[0] * 20 + [5, 5, 7]], [0] * 20 + [5, 5, 7])
    want = ordered(neighbours.search(few, few.where("vec_id IN (0, 5, 7)")).collect())
    assert len(want) == 60
    assert ordered(neighbours.search(few, asked).collect()) == want
    once = neighbours.search(few, asked, rerank=30)
    assert ordered(neighbours.search(many, asked, rerank=30).collect()) == ordered(once.collect())
    two = vectors_of(spark, x[[0, 1]], [100, 100])  # one id, two vectors
    got = [(r.vec_id, r.score) for r in neighbours.search(few, two).orderBy("rank").collect()]
    best = np.maximum((x.astype(np.float32) @ x[0]), (x.astype(np.float32) @ x[1]))
    assert [v for v, _ in got] == np.argsort(-best)[:20].tolist()


def test_radius_search_returns_every_code_within():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 16))
    code = neighbours.Code(np.zeros(17), rng.standard_normal((17, 24)), float((x ** 2).sum(1).max()), 3, 8)
    shard = neighbours.Shard(code, np.arange(500), x)
    for q in shard.parts[:40]:
        far = shard.distances(np.arange(500), q)
        got = shard.within(q, 30)
        assert set(got.tolist()) == set(np.flatnonzero(far <= np.sort(far)[29]).tolist())


def plain_best_fit(pieces, capacity):
    """Every open bin is tried."""
    bins, out = [], {}
    order = sorted(range(len(pieces)), key=lambda k: (-pieces[k][0], pieces[k][1], pieces[k][2],
                                                      str(pieces[k][3]), str(pieces[k][4])))
    for k in order:
        n, _, _, source, cluster = pieces[k]
        fits = [(rest, b) for b, (rest, s, c) in enumerate(bins)
                if rest >= n and (source is None or source not in s) and (cluster is None or cluster not in c)]
        if fits:
            _, b = min(fits)
        else:
            b = len(bins)
            bins.append((capacity, set(), set()))
        rest, s, c = bins[b]
        bins[b] = (rest - n, s | {source}, c | {cluster})
        out[k] = b
    return [out[k] for k in range(len(pieces))]


def test_packing_equals_plain_best_fit():
    rng = np.random.default_rng(2)
    pieces = [(int(rng.integers(0, 60)), int(k), 0, (None, "a", "a", "a", "b", "c")[rng.integers(6)],
               (None, *map(str, range(40)))[rng.integers(41)]) for k in range(400)]
    got = packing.pack_shard(pieces, 100)
    assert [b for b, _ in got] == plain_best_fit(pieces, 100)
    for b, places in collections.Counter(b for b, _ in got).items():
        assert sorted(p for x, p in got if x == b) == list(range(places))


def test_packing_invariants(spark):
    rows = some_rows(3) + [(900, "w " * 5000)]
    got = packing.pack(frame(spark, rows), capacity=64, shard_pieces=50).toPandas()
    words = collections.Counter()
    for i, t in rows:
        words[i] += len((t or "").encode().split())
    assert got.groupby(got.doc_id.fillna(-1)).n_words.sum().to_dict() == {
        (-1 if i is None else i): n for i, n in words.items()}
    assert got.groupby("bin_id").n_words.sum().max() <= 64
    for column in ("source", "cluster"):
        assert got.dropna(subset=[column]).groupby(["bin_id", column]).size().max() == 1
    assert packing.pack(empty(frame(spark, rows))).count() == 0


def test_contained_items_equal_plain_version(spark):
    rows = some_rows(6)
    items = [(k, " ".join((t or "").split()[3:30])) for k, (_, t) in enumerate(rows[:12])]
    items += [(50, None), (51, ""), (52, "x Y"), (53, "a"), (None, rows[4][1]), (0, items[0][1]),
              (54, "x y " * 3 + "z")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, rows)
    want = ordered(contained(rows, items))
    for block_bytes in (1 << 20, 500):
        got = decontaminate.contained(docs, table, block_bytes=block_bytes).select(
            "doc_id", "item_id", "n_shared", "n_item").collect()
        assert ordered(got) == want
    kept = decontaminate.clean(docs, table)
    assert kept.columns == docs.columns
    alone = [r for r in rows if not contained([r], items)]
    assert ordered((r.doc_id, r.text) for r in kept.collect()) == ordered(alone)
    assert decontaminate.contained(empty(docs), table).count() == 0
    assert decontaminate.contained(docs, empty(table)).count() == 0
    assert decontaminate.clean(docs, empty(table)).count() == len(rows)
