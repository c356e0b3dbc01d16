"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from llm_brute import empty, frame, linked, ordered, some_rows
from punctua.llm import jaccard, runs


@pytest.mark.parametrize("seed,size,percent", [(1, 4, 85), (5, 5, 80)])
def test_components_equal_all_pairs(spark, seed, size, percent):
    rows = some_rows(seed, 60)
    got = jaccard.linked(frame(spark, rows), size=size, percent=percent, run_bytes=3000).collect()
    assert ordered(got) == ordered(linked(rows, size, percent))


def test_group_of_near_copies(spark):
    """Copies of one text with scattered changes: many links, chains, and sets just below."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(150)] = f"n{rng.randint(0, 3000)}"
        rows.append((i, " ".join(words)))
    got = jaccard.linked(frame(spark, rows)).collect()
    assert ordered(got) == ordered(linked(rows))


def test_empty_table_and_kept_rows(spark):
    none = empty(frame(spark, [(1, "a")]))
    assert jaccard.linked(none).count() == 0
    rows = some_rows(2)
    docs = frame(spark, rows)
    kept = jaccard.kept_rows(docs)
    assert kept.columns == docs.columns
    want = [(i, t) for (i, t), r in zip(rows, linked(rows)) if i is None or r[2] == i]
    assert ordered((r.doc_id, r.text) for r in kept.collect()) == ordered(want)


def test_two_texts_under_one_id(spark):
    """A near copy of a smaller id goes; the other, unique text of its id stays."""
    copied, own = " ".join(f"w{k}" for k in range(80)), " ".join(f"u{k}" for k in range(80))
    rows = [(1, copied), (7, copied + " more"), (7, own), (7, None), (8, copied), (8, copied),
            (9, own), (None, own)]
    kept = jaccard.kept_rows(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert ordered((r.doc_id, r.text) for r in kept.collect()) == ordered(
        [(1, copied), (7, own), (7, None), (None, own)])


def test_components_of_a_long_chain(spark):
    names = list(range(60))
    rng = random.Random(1)
    rng.shuffle(names)
    edges = spark.createDataFrame(list(zip(names[:-1], names[1:])), "a bigint, b bigint")
    label = {r["node"]: r["component"] for r in jaccard.components(edges).collect()}
    assert set(label) == set(names) and set(label.values()) == {min(names)}


def test_texts_of_common_sentences_are_skipped(spark, monkeypatch):
    """Texts that share many sentences and yet do not link are not compared pair by pair."""
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(12)) for _ in range(40)]
    rows = [(i, " ".join(rng.sample(pool, 30))) for i in range(80)]
    rows += [(100 + i, t + " more") for i, t in rows[:10]]
    compared = []
    for name in ("overlaps", "grouped_overlaps"):
        plain = getattr(jaccard, name)
        monkeypatch.setattr(jaccard, name, lambda table, pairs, size, plain=plain: (
            compared.append(pairs.count()), plain(table, pairs, size))[1])
    got = jaccard.linked(frame(spark, rows)).collect()
    assert ordered(got) == ordered(linked(rows))
    assert sum(compared) < 100


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 40, 3000):
        one = rng.integers(0, 1 << 63, size=n, dtype=np.uint64)
        other = np.concatenate([one[:n // 2], rng.integers(0, 1 << 63, size=n, dtype=np.uint64)])
        bits = np.bitwise_count(jaccard.sketch_of(one) ^ jaccard.sketch_of(other)).sum()
        assert bits <= len(np.setxor1d(one, other))
        assert not (jaccard.sketch_of(one) ^ jaccard.sketch_of(one[::-1])).any()


def test_short_sets_have_lists_with_pivots(spark):
    """Sets of few prefix shingles would else meet no pivot, and their groups pair by pair."""
    rows = spark.createDataFrame([(t, 30 if t % 2 else 2000) for t in range(64)], "token bigint, n int")
    got = rows.where(jaccard._has_pivot(85)).collect()
    assert sum(r.n == 30 for r in got) == 32 and sum(r.n == 2000 for r in got) == 8


def test_staged_tables_are_removed(spark):
    """Of a chain of contractions only the last edges stay on disk."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)], "a bigint, b bigint")
    with runs.scope() as folders:
        label = jaccard.components(edges)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [hadoop.Path(f) for f in folders]
    assert len(paths) > 2 and sum(p.getFileSystem(conf).exists(p) for p in paths) == 1
    assert {r["component"] for r in label.collect()} == {0}


def test_counts_are_those_of_all_runs():
    """Runs ask with their counts; every value gets the power of two of the sum."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, size=3000, dtype=np.uint64)
    texts = [rng.choice(pool, size=k) for k in (5000, 1, 700, 0)]
    own = [runs.Counted(t, 7) for t in texts]
    answers = [{} for _ in texts]
    for bucket in range(7):
        asked = [(k, dict(c.asked())[bucket]) for k, c in enumerate(own) if bucket in dict(c.asked())]
        for (k, _), told in zip(asked, runs.powers([b for _, b in asked])):
            answers[k][bucket] = told
    values, counts = np.unique(np.concatenate(texts), return_counts=True)
    want = dict(zip(values.tolist(), np.frexp(counts)[1].tolist()))
    for t, c, a in zip(texts, own, answers):
        assert c.told(a)[c.places(t)].tolist() == [want[v] for v in t.tolist()]


def test_lists_stay_short_among_many_texts(spark):
    """Passages of three texts are not in prefixes, however many shingles other texts have."""
    rows = []
    for i in range(1500):
        words = [f"u{i}x{k}" for k in range(600)]
        words[i % 500:i % 500] = [f"p{i // 3}x{k}" for k in range(30)]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    _, _, postings = jaccard.described(runs.packed(docs, "doc_id", "text"), "bigint", 4, 85)
    assert postings.count() == 0
