"""Language-model scores: counts and base scores against plain ones, gradients, held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from llm_brute import empty, frame, some_rows
from punctua.llm import recurrent
from punctua.llm import runs as R

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def plain(rows):
    tokens = [[*WORD.findall(lowered(t)), None] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(w for own, held in zip(tokens, out) if not held for w in own)
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, held, len(own), sum(w in counts for w in own), n,
                    sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
                   for (i, _), own, held in zip(rows, tokens, out)), key=repr), counts


def same(got, want):
    got = sorted((tuple(r)[:6] for r in got), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9, atol=1e-9)


def test_base_columns_and_defined_cases(spark):
    rows = [(k if i is None or i < 100 else i, t) for k, (i, t) in enumerate(some_rows(3))]
    rows += [(None, None), (None, "A b c"), rows[3], rows[3], (2 ** 60, "The THE the É")]
    got = recurrent.score_documents(frame(spark, rows)).collect()
    same(got, plain(rows)[0])
    assert all(r.score < 0 for r in got)
    copies = [r.score for r in got if r.doc_id == rows[3][0]]
    assert len(copies) == 3 and np.ptp(copies) < 1e-3  # the same text, the same score


def test_without_training_documents(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    got = recurrent.score_documents(frame(spark, [(i, "some words") for i in ids])).collect()
    assert [tuple(r)[1:] for r in got] == [(True, 3, 0, 0, 0.0, 0.0)] * 4
    assert recurrent.score_documents(empty(frame(spark, [(1, "a")]))).count() == 0


def test_given_documents_whole(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", "text").collect()]
    got = recurrent.op13_recurrent(spark, SF).collect()
    same(got, plain(rows)[0])
    held = [r for r in got if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    # On texts that training never saw the network does better than the word counts.
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.03


def counts_for(words=100):
    total = np.sort(np.random.default_rng(1).integers(2, 500, words))[::-1].copy()
    rest = np.array([4.5, 9.0])
    return recurrent.Counts(int(total.sum()) + 10, words + 6, np.arange(words, dtype=np.uint64) * 7 + 3,
                            total, np.array([0, 1]), rest)


def moved(network, rng):
    """In double precision, with all weights moved away from zero."""
    network.flat = network.flat.astype(np.float64) + rng.normal(size=network.size) * 0.1
    network.w = network.views(network.flat, network.shapes)
    return network


def test_probabilities_sum_to_one():
    counts = counts_for()
    network = moved(recurrent.Network(counts), np.random.default_rng(2))
    state = np.random.default_rng(3).normal(size=(1, recurrent.HIDDEN))
    every = np.arange(network.words + 2)
    network.w["bw"][network.words:] = -1e9  # unused places of the last class
    logs, _ = network.logs(np.repeat(state, len(every), axis=0), every)
    assert math.isclose(np.exp(logs).sum(), 1.0, rel_tol=1e-6)


def test_gradient_is_that_of_the_loss():
    counts, rng = counts_for(), np.random.default_rng(4)
    network = moved(recurrent.Network(counts), rng)
    sizes = np.array([9, 5, 1, 7])
    tokens = rng.integers(0, network.words + 2, sizes.sum())
    inputs, targets, _ = next(recurrent.windows(tokens, np.cumsum(sizes) - sizes, sizes, 2,
                                                network.start))
    state = rng.normal(size=(2, recurrent.HIDDEN))

    def loss():
        out, _, _ = network.steps(inputs, state, network.table())
        real = targets >= 0
        return -network.logs(out[real].astype(np.float64), targets[real])[0].mean()

    gradient, _ = network.slopes(inputs, targets, state)
    at = 0
    for shape in network.shapes.values():
        size = int(np.prod(shape))
        k = at + int(np.abs(gradient[at:at + size]).argmax())
        old, values = network.flat[k], []
        for step in (1e-3, -1e-3):
            network.flat[k] = old + step
            values.append(loss())
        network.flat[k] = old
        assert math.isclose(gradient[k], (values[0] - values[1]) / 2e-3, rel_tol=2e-3)
        at += size


def test_state_is_carried_to_the_end_of_a_document():
    """Windows and lanes do not show in a score; a document starts from a clear state."""
    counts, rng = counts_for(), np.random.default_rng(5)
    network = recurrent.Network(counts, moved(recurrent.Network(counts), rng).flat)
    sizes = np.array([500, 3, 1, 77, 77])
    tokens = rng.integers(0, network.words + 2, sizes.sum())
    tokens[-77:] = tokens[-154:-77]
    logs = recurrent.likelihoods(network, tokens, sizes)
    assert math.isclose(logs[3], logs[4], rel_tol=1e-4)
    at = 0
    for n, found in zip(sizes, logs):  # one step at a time
        own, h, total = tokens[at:at + n], np.zeros((1, recurrent.HIDDEN), np.float32), 0.0
        for k, token in enumerate(own):
            inputs = np.array([[network.start if k == 0 else own[k - 1]]])
            out, h, _ = network.steps(inputs, h, network.table())
            total += network.logs(out[0], np.array([token]))[0][0]
        assert math.isclose(total, found, rel_tol=1e-4)
        at += n


def test_lanes_take_every_piece_once():
    sizes = np.array([5, 1, 9, 2, 2, 30])
    lanes = recurrent.lanes_of(sizes, 3)
    assert sorted(i for own in lanes for i in own) == list(range(6))
    assert [sum(sizes[i] for i in own) for own in lanes] == [30, 10, 9]
    assert R.NO_ID not in sizes


def test_runs_of_a_task_share_their_lanes(spark):
    """A round's weights follow from the documents of a task, not from their runs."""
    counts, rng, begin = counts_for(), np.random.default_rng(6), 0
    ids = np.arange(400)
    sizes = rng.integers(1, 60, len(ids))
    tokens = rng.integers(0, 102, sizes.sum())
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def table(cuts):
        rows = [(ids[a:b].tobytes(), sizes[a:b].tobytes(),
                 R.press(tokens[ends[a]:ends[b]].astype("<u2").tobytes()))
                for a, b in zip(cuts, cuts[1:])]
        return spark.createDataFrame(rows, "ids binary, sizes binary, tokens binary").coalesce(1)

    flat = recurrent.Network(counts).flat
    whole, cut = (recurrent.averaged(table(c), counts, flat, begin, 4, 5, 1)
                  for c in ([0, 400], [0, 90, 91, 250, 400]))
    assert not np.array_equal(whole, flat)
    assert np.array_equal(whole, cut)


def test_words_are_distinct_and_in_order():
    rng = np.random.default_rng(7)
    hashes = rng.integers(0, 1 << 63, 50, dtype=np.uint64)[rng.integers(0, 50, 300)] * np.uint64(2)
    words = recurrent.Words(hashes, 8)
    keys, inverse = np.unique(hashes, return_inverse=True)
    assert np.array_equal(words.keys, keys) and np.array_equal(words.inverse, inverse)
    assert recurrent.Words(hashes[:0], 8).parts == []


def test_a_state_outlives_the_next_window():
    network = recurrent.Network(counts_for())
    inputs = np.random.default_rng(8).integers(0, 102, (4, 6))
    state = np.zeros((6, recurrent.HIDDEN), np.float32)
    _, first = network.slopes(inputs, inputs, state)
    kept = first.copy()
    again, _ = network.slopes(inputs[::-1], inputs, first)
    assert np.array_equal(first, kept)
    fresh, _ = recurrent.Network(counts_for()).slopes(inputs[::-1], inputs, kept)
    assert np.array_equal(again, fresh)
