"""Suffix and recompression dedup against plain versions."""

import os

import numpy as np
import pytest
from llm_brute import empty, frame, ordered, removed_bytes, removed_words, some_rows
from punctua.llm import recompression, suffixes
from punctua.llm import runs as R

ONE = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
FIVE = ["doc_id", "n_words", "n_removed", "kept_sha256"]


@pytest.mark.parametrize("seed,run_bytes", [(1, 1 << 20), (2, 2000)])
def test_bytes_equal_plain_version(spark, seed, run_bytes):
    rows = some_rows(seed)
    got = suffixes.dedup(frame(spark, rows), run_bytes=run_bytes).select(ONE).collect()
    assert ordered(got) == ordered(removed_bytes(rows))


@pytest.mark.parametrize("seed,run_bytes", [(1, 1 << 20), (3, 2000)])
def test_words_equal_plain_version(spark, seed, run_bytes):
    rows = some_rows(seed)
    got = recompression.dedup(frame(spark, rows), run_bytes=run_bytes).select(FIVE).collect()
    assert ordered(got) == ordered(removed_words(rows))


def test_empty_tables(spark):
    none = empty(frame(spark, [(1, "a")]))
    assert suffixes.dedup(none).count() == 0
    assert recompression.dedup(none).count() == 0
    assert suffixes.cut_texts(none).columns == none.columns


def test_texts_longer_than_a_piece(monkeypatch):
    rng = np.random.default_rng(5)
    names = rng.integers(0, 6, 4000).astype(np.uint64)
    edge = np.array([0, 4000])
    whole = dict(zip(*(x.tolist() for x in recompression.anchors(names, edge, 35)[:2])))
    for a in range(0, 4000 - 700, 500):  # a window's anchor does not depend on what is around it
        part = recompression.anchors(names[a:a + 700], np.array([0, 700]), 35)
        assert all(whole[a + s] == f for s, f in zip(*(x.tolist() for x in part[:2])))


def test_merge_orders_and_gives_common_prefixes():
    rng = np.random.default_rng(3)
    runs = []
    for n in (0, 7, 1, 30, 12):
        rows = np.sort(rng.integers(0, 3, (n, 6)).astype(np.uint8).view("S6").ravel())
        runs.append(np.array([list(r.ljust(6, b"\0")) for r in rows], dtype=np.uint8).reshape(n, 6))
    keys = [[int.from_bytes(bytes(r), "big") for r in run] for run in runs]
    of, place, prefix = suffixes.merged(keys, [suffixes.common(r).tolist() for r in runs], 6)
    merged = np.array([runs[r][p] for r, p in zip(of, place)])
    assert [bytes(x) for x in merged] == sorted(bytes(x) for run in runs for x in run)
    assert prefix == suffixes.common(merged).tolist()


def test_front_coding_round_trip():
    rng = np.random.default_rng(4)
    rows = np.zeros((50, 50 + 1 + 34 + 1), dtype=np.uint8)
    for k in range(50):
        right, left = int(rng.integers(16, 51)), int(rng.integers(0, 35))
        rows[k, :right] = rng.integers(0, 3, right)
        rows[k, 50], rows[k, -1] = right, left + 1
        rows[k, 51:51 + left] = rng.integers(0, 255, left)
    rows = rows[suffixes.sorted_rows(rows, np.zeros(50, dtype=np.int64))]
    owner = np.arange(50) * 7
    right, before, n_right, n_left, ids, _ = suffixes.decoded(
        suffixes.front_coded(rows, owner, 50), 50, 34)
    assert (right == rows[:, :50]).all() and (before == rows[:, 51:-1]).all()
    assert (n_right == rows[:, 50]).all() and (n_left == rows[:, -1] - 1).all()
    assert (ids == owner).all()


def test_cut_texts_keep_columns_and_untouched_rows(spark):
    rows = some_rows(4)
    docs = frame(spark, rows)
    cut = suffixes.cut_texts(docs)
    assert cut.columns == docs.columns
    plain = {}
    for (i, t), r in zip(rows, removed_bytes(rows)):
        plain.setdefault((i, t), r)
    whole = [(i, t) for (i, t), r in plain.items() if r[2] == 0]
    left = {(r.doc_id, r.text) for r in cut.collect()}
    assert all(x in left for x in whole)
    gone = sum(1 for k, (i, t) in enumerate(rows) if 0 < len((t or "").encode()) == plain[i, t][2])
    assert cut.count() <= len(rows) - gone


def test_cut_texts_leave_no_runs_behind(spark, capsys):
    """The join with the documents reads what is cut; runs and answers are removed before it."""
    docs = frame(spark, some_rows(4))
    with R.scope() as folders:
        cut = suffixes.cut_texts(docs)
    cut.explain()
    assert "MapInArrow" not in capsys.readouterr().out
    assert [os.path.exists(f.removeprefix("file:")) for f in folders] == [False] * (
        len(folders) - 1) + [True]
