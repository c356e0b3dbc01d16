"""Removal of repeated word passages by recompression.

Texts are rewritten in rounds. A round names each maximal run of one symbol, then each pair of a
"left" symbol followed by a "right" one, the side being a bit of the symbol's name. Names are
64-bit hashes of the rule, so all tasks give one substring one name without a dictionary.
Every symbol carries its support, the words on which its parse depends. A symbol whose support
lies inside a window is interior to it: any other place of the same words parses to the same
symbol. Each window of ``window`` words takes its interior symbol of the highest level (the
smallest hash among these) as its anchor, named with all words of its support; single words are
interior always, so every window has one, and equal windows have equal anchors at the same place.

Two Spark rounds follow. The first finds the anchor symbols that occur more than once in the
corpus; a window without a shared anchor cannot repeat. The second compares 96-bit fingerprints of
the words of all remaining windows and so verifies the repeats.

Defined cases: words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null and empty texts have no words;
texts shorter than a window lose none. Repeated rows are separate places, so each loses what
the other holds. A null id is returned as null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from punctua.llm import runs as R
from punctua.llm import words as W

U = np.uint64
ROUNDS = 4
PIECE = 1 << 20  # words parsed at a time; the packed minima below rely on it


def _seed(k: int) -> np.uint64:
    return W.mix(np.array([k + 1], dtype=np.uint64) * W.BASES[0])[0]


def parse(names: np.ndarray, edge: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(names, support starts, support ends) of each level, the words first.

    ``edge`` holds the first word of every text and the number of words. A support that
    reaches over a text's edge ends one word beyond it, outside of all windows.
    """
    n = len(names)
    text = np.zeros(n, dtype=np.int64)
    text[edge[1:-1]] = 1
    text = np.cumsum(text)
    before, after = edge[:-1] - 1, edge[1:] + 1  # support of what depends on a text's edge
    low, high = np.arange(n), np.arange(1, n + 1)
    yield names, low, high
    for r in range(ROUNDS):
        # Runs of one symbol: maximal, so they depend on both neighbours.
        first = np.ones(len(names), dtype=bool)
        first[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(names)))
        last = start + length - 1
        left, right = before[text[start]], after[text[start]]
        inner = text[start[1:]] == text[start[:-1]]
        left[1:][inner] = low[last[:-1]][inner]
        right[:-1][inner] = high[start[1:]][inner]
        named = names[start]
        several = length > 1
        named[several] = W.mix(named[several] * W.BASES[1] + length[several].astype(np.uint64)
                               * W.BASES[0] + _seed(2 * r))
        names, low, high, text = named, left, right, text[start]
        # Pairs of a left and a right symbol.
        side = (W.mix(names + _seed(2 * r + 1)) >> U(63)).astype(bool)
        pair = np.zeros(len(names), dtype=bool)
        pair[:-1] = ~side[:-1] & side[1:] & (text[1:] == text[:-1])
        second = np.zeros(len(names), dtype=bool)
        second[1:] = pair[:-1]
        at = np.flatnonzero(pair)
        new, left, right = names.copy(), low.copy(), high.copy()
        new[at] = W.mix(names[at] * W.BASES[1] + W.mix(names[at + 1]) + _seed(2 * r + 1))
        right[at] = high[at + 1]
        # A single left symbol depends on what follows, a single right one on what precedes.
        single = ~pair & ~second
        k = np.flatnonzero(single & ~side)
        follows = np.minimum(k + 1, len(names) - 1)
        right[k] = np.where((k + 1 < len(names)) & (text[follows] == text[k]), high[follows],
                            after[text[k]])
        k = np.flatnonzero(single & side)
        precedes = np.maximum(k - 1, 0)
        left[k] = np.where((k > 0) & (text[precedes] == text[k]), low[precedes], before[text[k]])
        kept = ~second
        names, low, high, text = new[kept], left[kept], right[kept], text[kept]
        yield names, low, high


def anchors(names: np.ndarray, edge: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(starts, anchor hashes, anchor places) of all windows inside texts; at most ``PIECE`` words."""
    n = len(names)
    valid = np.ones(max(0, n - window + 1), dtype=bool)
    for e in edge[1:-1].tolist():  # no window crosses into the next text
        valid[max(0, e - window + 1):e] = False
    open_ = np.flatnonzero(valid)
    starts, found, place = open_, np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    if not len(starts):
        return starts, found[:0], place[:0]
    levels, sums = list(parse(names, edge)), W.prefix_sums(names)
    for level in range(len(levels) - 1, -1, -1):
        own, low, high = levels[level]
        a = np.searchsorted(low, open_, "left")
        b = np.searchsorted(high, open_ + window, "right")
        has = b > a
        p, a, b = open_[has], a[has], b[has]
        if len(p):
            hashed = W.mix(own + _seed(100 + level))
            # The smallest hash, the leftmost of equals: the number of the symbol is packed in.
            table = [(hashed >> U(20) << U(20)) | np.arange(len(own), dtype=np.uint64)]
            span = b - a
            while (1 << len(table)) <= span.max():
                half, t = 1 << (len(table) - 1), table[-1]
                table.append(np.minimum(t[:-half], t[half:]))
            power = np.frexp(span.astype(np.float64))[1] - 1
            best = np.empty(len(p), dtype=np.uint64)
            for k, t in enumerate(table):
                of = power == k
                if of.any():
                    best[of] = np.minimum(t[a[of]], t[b[of] - (1 << k)])
            k = (best & U((1 << 20) - 1)).astype(np.int64)
            found[p] = W.mix(hashed[k] + W.spans(sums, low[k], high[k]))
            place[p] = low[k]
            open_ = open_[~has]
        if not len(open_):
            break
    return starts, found[starts], place[starts]


class Parsed:
    """Words and windows of a run's texts."""

    def __init__(self, texts: list[bytes], window: int):
        self.window = window
        lanes = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, h in W.word_hashes(texts, lower=False):
            counts[k] = len(h)
            lanes.append(h)
        self.names = np.concatenate(lanes) if lanes else np.zeros(0, dtype=np.uint64)
        self.edge = np.concatenate([[0], np.cumsum(counts)])
        starts, found, first = [], [], []
        for a, b in self._pieces():
            inside = self.edge[(self.edge > a) & (self.edge < b)]
            edge = np.concatenate([[0], inside - a, [b - a]])
            edge = edge[np.diff(edge, prepend=-1) > 0]
            s, f, p = anchors(self.names[a:b], edge, window)
            starts.append(s + a)
            found.append(f)
            new = np.ones(len(s), dtype=bool)
            new[1:] = (f[1:] != f[:-1]) | (p[1:] != p[:-1])
            first.append(new)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
        self.anchors = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
        # Neighbouring windows share an anchor; it counts once, at the first of them.
        self.first = np.concatenate(first) if first else np.zeros(0, dtype=bool)

    def _pieces(self) -> Iterator[tuple[int, int]]:
        """Stretches of whole texts; a longer text in pieces that share window - 1 words."""
        size, a, n = PIECE, 0, len(self.names)
        while a < n:
            b = int(self.edge[np.searchsorted(self.edge, a + size, "right") - 1])
            if b > a:
                yield a, b
                a = b
                continue
            end = int(self.edge[np.searchsorted(self.edge, a, "right")])
            while end - a > size:
                yield a, a + size
                a += size - self.window + 1
            yield a, end
            a = end

    def fingerprints(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two lanes (64 and 32 bits) of the words of the windows at ``starts[picked]``."""
        first = np.zeros(len(picked), dtype=np.uint64)
        second = np.zeros(len(picked), dtype=np.uint64)
        at = self.starts[picked]
        for j in range(self.window):
            word = self.names[at + j]
            first = (first + word) * W.BASES[0]
            second = (second ^ word) * W.BASES[1] + (second >> U(29))
        return W.mix(first), (W.mix(second) >> U(32)).astype(np.uint32)


class Windows:
    """Distinct fingerprints of a run's candidate windows, by bucket."""

    def __init__(self, first: np.ndarray, second: np.ndarray, n: int):
        bucket = (first % U(n)).astype(np.int64)
        order = np.lexsort((second, first, bucket))
        f, s, b = first[order], second[order], bucket[order]
        new = np.ones(len(f), dtype=bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        group = np.cumsum(new) - 1
        self.inverse = np.empty(len(f), dtype=np.int64)
        self.inverse[order] = group
        self.first, self.second = f[new], s[new]
        self.counts = np.bincount(group, minlength=len(self.first)) if len(f) else group
        own = b[new]
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        self.parts = [(int(own[a]), a, z) for a, z in zip(cuts, np.append(cuts[1:], len(own)))]

    def asked(self) -> Iterator[tuple[int, bytes]]:
        for bucket, a, z in self.parts:
            yield bucket, (self.first[a:z].tobytes() + self.second[a:z].tobytes()
                           + (self.counts[a:z] > 1).astype(np.uint8).tobytes())

    def told(self, answers: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(self.first), dtype=bool)
        for bucket, a, z in self.parts:
            if bucket in answers:
                out[a:z] = np.unpackbits(np.frombuffer(answers[bucket], dtype=np.uint8),
                                         count=z - a)
        return out[self.inverse]


def repeated(asked: list[bytes]) -> list[bytes]:
    """Answer of a bucket: which fingerprints occur more than once."""
    sizes = [len(b) // 13 for b in asked]
    first = np.concatenate([np.frombuffer(b, dtype=np.uint64, count=n)
                            for b, n in zip(asked, sizes)])
    second = np.concatenate([np.frombuffer(b, dtype=np.uint32, count=n, offset=8 * n)
                             for b, n in zip(asked, sizes)])
    more = np.concatenate([np.frombuffer(b, dtype=np.uint8, offset=12 * n)
                           for b, n in zip(asked, sizes)])
    order = np.lexsort((second, first))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    group = np.cumsum(new) - 1
    told = np.empty(len(order), dtype=bool)
    told[order] = np.bincount(group, weights=1 + more[order])[group] >= 2
    ends = np.cumsum(sizes)
    return [np.packbits(told[e - n:e]).tobytes() for e, n in zip(ends, sizes)]


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n places a window from ``starts`` covers."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35,
          run_bytes: int = R.RUN_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every document."""
    table = R.packed(docs, doc_id, text, run_bytes, in_buckets=True)
    n = R.buckets(docs)
    kind = docs.schema[doc_id].dataType
    id_kind = pa.int64() if kind.simpleString() == "bigint" else pa.int32()

    def first(row: dict) -> Iterator[pa.RecordBatch]:
        parsed = Parsed(R.opened(row)[1], window)
        values = R.Values(parsed.anchors, n)
        places = np.bincount(values.inverse[parsed.first], minlength=len(values.keys))
        yield R.questions(row["run"], values.asked(places > 1))

    def candidates(row: dict) -> tuple[Parsed, np.ndarray, Windows]:
        parsed = Parsed(R.opened(row)[1], window)
        told = R.Values(parsed.anchors, n).told(R.by_bucket(row["shared"]))
        picked = np.flatnonzero(told)
        return parsed, picked, Windows(*parsed.fingerprints(picked), n)

    def second(row: dict) -> Iterator[pa.RecordBatch]:
        yield R.questions(row["run"], candidates(row)[2].asked())

    def last(row: dict) -> Iterator[pa.RecordBatch]:
        ids, texts = R.opened(row)
        parsed, picked, windows = candidates(row)
        hit = parsed.starts[picked[windows.told(R.by_bucket(row["answers"]))]]
        gone = covered(hit, window, len(parsed.names))
        removed = np.concatenate([[0], np.cumsum(gone)])
        counts = np.diff(parsed.edge)
        lost = removed[parsed.edge[1:]] - removed[parsed.edge[:-1]]
        kept = []
        for k, t in enumerate(texts):
            found = t.split()
            a, b = parsed.edge[k], parsed.edge[k + 1]
            if lost[k]:
                found = [w for w, g in zip(found, gone[a:b].tolist()) if not g]
            kept.append(b" ".join(found))
        yield pa.RecordBatch.from_arrays(
            [R.id_column(ids, id_kind), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()),
             pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    # Answers are small and staged, so that no round is computed again for the next one.
    shared = R.staged(R.answered(R.mapped(table, first, R.ASKED), R.several), "shared")
    told = R.returned(table, shared, "shared")
    answers = R.staged(R.answered(R.mapped(told, second, R.ASKED), repeated), "answers")
    return R.mapped(R.returned(told, answers), last,
                    f"doc_id {kind.simpleString()}, n_words bigint, n_removed bigint, "
                    "kept_sha256 string, kept_text string")


def op5_recompression(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
