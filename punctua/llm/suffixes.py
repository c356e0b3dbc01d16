"""Removal of byte passages that an earlier document holds: distributed merge of suffix runs.

A byte is removed when a string of ``window`` bytes that covers it also starts in a document with
a smaller id. Sorting all suffixes is not needed for that: each window takes the ``seed`` bytes
of smallest hash inside it (the leftmost of equals) as its anchor, so equal windows have their
anchors at the same place, and only suffixes that begin at anchors are sorted.

1. Each run of documents tells which anchor seeds it holds; seeds of one document only are done.
2. Each run sorts the suffixes at its shared anchors, bounded to the end of the last window with
   that anchor, each with the bytes before the anchor back to the first such window. Equal entries
   become one with the smallest id. The sorted run is sent front-coded: the length of the prefix
   shared with the entry before, and the rest.
3. A task per bucket of seeds merges the sorted runs with a loser tree. Each entry carries its
   common prefix length with the last winner; two entries with unequal lengths are decided by
   these, and only bytes beyond a known prefix are compared. The merge yields the order and the
   common prefix of neighbours, from which the windows that agree to the right of the anchor
   follow for every distance; those that agree to the left too are one string, whose
   smallest id is compared with each entry's own.
4. The runs get a bit per entry and window and cut their documents.

A passage travels once per run, however often it occurs there.

Defined cases: null and empty texts are no bytes; texts shorter than a window lose none. Rows
with equal ids do not cut each other. A null id counts as larger than all others and is returned
as null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctua.llm import runs as R
from punctua.llm import words as W
from punctua.llm.recompression import covered

U = np.uint64
PIECE = 1 << 20  # bytes hashed at a time; the packed minima below rely on it


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:])


class Anchored:
    """Anchors of a run's texts and the windows that have them.

    ``data`` is all texts; entry k covers the windows that start in [first[k], last[k]] and
    have their anchor at place at[k], with the seed hash seeds[k], in text of[k]; whole[k] is a
    hash of all their bytes and of the anchor's place among them.
    """

    def __init__(self, texts: list[bytes], window: int, seed: int):
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.edge = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        n, found = len(self.data), []
        step = PIECE - window
        for a in range(0, max(0, n - window + 1), step):
            found.append(self._piece(a, min(n, a + step + window - 1), window, seed))
        parts = [np.concatenate(x) if found else np.zeros(0, dtype=np.int64)
                 for x in (zip(*found) if found else [[]] * 5)]
        self.at, self.first, self.last = (p.astype(np.int64) for p in parts[:3])
        self.seeds, self.whole = (p.astype(np.uint64) for p in parts[3:])
        # A text's windows may be cut by a piece; both parts are entries of their own.
        self.of = np.searchsorted(self.edge, self.first, "right") - 1

    def _piece(self, a: int, b: int, window: int, seed: int) -> tuple[np.ndarray, ...]:
        data = self.data[a:b]
        sums = W.prefix_sums(W.CODES[0][data])
        starts = np.arange(len(data) - seed + 1)
        hashed = W.spans(sums, starts, starts + seed)
        best = sliding_minimum((hashed >> U(20) << U(20)) | starts.astype(np.uint64),
                               window - seed + 1)
        at = (best & U(PIECE - 1)).astype(np.int64)
        valid = np.ones(len(at), dtype=bool)
        inside = self.edge[(self.edge > a) & (self.edge < b)] - a
        if len(inside):  # no window crosses into the next text
            cross = np.zeros(len(at) + window + 1, dtype=np.int64)
            np.add.at(cross, np.maximum(inside - window + 1, 0), 1)
            np.add.at(cross, np.minimum(inside, len(at) + window), -1)
            valid = np.cumsum(cross[:len(at)]) == 0
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1
        ok = valid[begin]
        begin, end = begin[ok], end[ok]
        whole = W.spans(sums, begin, end + window) + W.mix((at[begin] - begin).astype(np.uint64))
        return at[begin] + a, begin + a, end + a, hashed[at[begin]], whole


class Entries:
    """The distinct sorted entries of a run, by bucket of their seeds."""

    def __init__(self, found: Anchored, picked: np.ndarray, ids: np.ndarray, window: int,
                 seed: int, n: int):
        # Equal entries have one seed and one hash: 128 bits. The smallest id stands for them.
        seeds, whole = found.seeds[picked], found.whole[picked]
        order = np.lexsort((whole, seeds))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (seeds[order][1:] != seeds[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        begin = np.flatnonzero(new)
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        owner = ids[found.of[picked]][order]
        owner = np.minimum.reduceat(owner, begin) if len(begin) else owner
        one = picked[order[begin]]
        rows = entry_rows(found, one, window, seed)
        bucket = (found.seeds[one] % U(n)).astype(np.int64)
        kept = sorted_rows(rows, bucket)
        back = np.empty_like(kept)
        back[kept] = np.arange(len(kept))
        self.inverse = back[group]
        self.rows, self.owner = rows[kept], owner[kept]
        own = bucket[kept]
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        self.parts = [(int(own[a]), a, b) for a, b in zip(cuts, np.append(cuts[1:], len(own)))]
        self.window = window

    def asked(self) -> Iterator[tuple[int, bytes]]:
        for bucket, a, b in self.parts:
            yield bucket, front_coded(self.rows[a:b], self.owner[a:b], self.window)

    def told(self, answers: dict[int, bytes]) -> np.ndarray:
        """Per entry a row of bits: which windows an earlier document holds."""
        width = self.rows.shape[1] - self.window - 1
        out = np.zeros((len(self.rows), width), dtype=bool)
        for bucket, a, b in self.parts:
            if bucket in answers:
                bits = np.frombuffer(R.unpress(answers[bucket]), dtype=np.uint8)
                out[a:b] = np.unpackbits(bits, count=(b - a) * width).reshape(b - a, width)
        return out


def entry_rows(found: Anchored, picked: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Bytes from the anchor on, their number, bytes before it (the nearest first), theirs + 1."""
    reach, size = window - seed, len(found.data)
    at, first, last = found.at[picked], found.first[picked], found.last[picked]
    left, right = at - first, last + window - at
    rows = np.zeros((len(at), window + 1 + reach + 1), dtype=np.uint8)
    for j in range(window):
        rows[:, j] = np.where(j < right, found.data[np.minimum(at + j, size - 1)], 0)
    rows[:, window] = right
    for j in range(reach):
        rows[:, window + 1 + j] = np.where(j < left, found.data[np.maximum(at - 1 - j, 0)], 0)
    rows[:, -1] = left + 1
    return rows


def sorted_rows(rows: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Order of byte rows by bucket, then bytes."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    wide[:, :width] = rows
    return np.lexsort((*wide.view(">u8").astype(np.uint64).T[::-1], bucket))


def common(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before; 0 for the first."""
    out = np.zeros(len(rows), dtype=np.int64)
    differ = rows[1:] != rows[:-1]
    out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def front_coded(rows: np.ndarray, owner: np.ndarray, window: int) -> bytes:
    """Sorted entries: prefix lengths, sizes, ids, then the suffixes' rests and left sides."""
    n = len(rows)
    shared = common(rows[:, :window])
    right, left = rows[:, window].astype(np.int64), rows[:, -1].astype(np.int64) - 1
    place = np.arange(window)
    rest = rows[:, :window][(place >= shared[:, None]) & (place < right[:, None])]
    before = rows[:, window + 1:-1][np.arange(rows.shape[1] - window - 2) < left[:, None]]
    return R.press(np.int64(n).tobytes() + shared.astype(np.uint8).tobytes()
                   + right.astype(np.uint8).tobytes() + left.astype(np.uint8).tobytes()
                   + owner.astype(np.int64).tobytes() + rest.tobytes() + before.tobytes())


def decoded(blob: bytes, window: int, reach: int) -> tuple[np.ndarray, ...]:
    """(right bytes, left bytes, right sizes, left sizes, ids, prefix lengths) of a run."""
    data = np.frombuffer(R.unpress(blob), dtype=np.uint8)
    n = int(data[:8].view(np.int64)[0])
    at = 8
    shared, right, left = (data[at + k * n:at + (k + 1) * n].astype(np.int64) for k in range(3))
    at += 3 * n
    owner = np.frombuffer(data[at:at + 8 * n].tobytes(), dtype=np.int64)
    at += 8 * n
    place = np.arange(window)
    own = (place >= shared[:, None]) & (place < right[:, None])
    rows = np.zeros((n, window), dtype=np.uint8)
    used = int(own.sum())
    rows[own] = data[at:at + used]
    number = np.arange(n)
    for j in range(window):  # a shared byte stands in the last row that has its own
        source = np.maximum.accumulate(np.where(shared <= j, number, 0))
        rows[:, j] = np.where(j < right, rows[source, j], 0)
    before = np.zeros((n, reach), dtype=np.uint8)
    before[np.arange(reach) < left[:, None]] = data[at + used:]
    return rows, before, right, left, owner, shared


def merged(keys: list[list[int]], shared: list[list[int]], width: int
           ) -> tuple[list[int], list[int], list[int]]:
    """Loser-tree merge of sorted runs: (run of each entry, place in it, common prefix).

    ``keys`` are ``width``-byte strings as whole numbers, ``shared`` their common prefixes with
    the entry before in the run. The common prefix returned is that with the entry before
    in the merged order.
    """
    runs = len(keys)
    size = 1
    while size < runs:
        size *= 2
    end = -1  # common prefix of an exhausted run: loses against all others
    key = [k[0] if k else 0 for k in keys] + [0] * (size - runs)
    lcp = [0 if k else end for k in keys] + [end] * (size - runs)
    place = [0] * size
    total = sum(map(len, keys))
    loser = [0] * size

    def beats(a: int, b: int) -> int:
        """The winner of runs a and b; the loser then holds its common prefix with it."""
        if lcp[a] != lcp[b]:  # the longer prefix shared with the last winner comes first
            return a if lcp[a] > lcp[b] else b
        if lcp[a] == end:
            return a if a < b else b
        x, y = key[a], key[b]
        if x == y:
            w, o = (a, b) if a < b else (b, a)
            lcp[o] = width
            return w
        prefix = width - ((x ^ y).bit_length() + 7) // 8
        if x < y:
            lcp[b] = prefix
            return a
        lcp[a] = prefix
        return b

    winner = list(range(size)) * 2
    for node in range(size - 1, 0, -1):
        a, b = winner[2 * node] if 2 * node < size else 2 * node - size, 0
        b = winner[2 * node + 1] if 2 * node + 1 < size else 2 * node + 1 - size
        won = beats(a, b)
        winner[node], loser[node] = won, b if won == a else a
    champion = winner[1] if size > 1 else 0
    runs_out, places, prefixes = [0] * total, [0] * total, [0] * total
    for k in range(total):
        p = place[champion]
        runs_out[k], places[k], prefixes[k] = champion, p, lcp[champion]
        p += 1
        place[champion] = p
        own = keys[champion]
        if p < len(own):
            key[champion], lcp[champion] = own[p], shared[champion][p]
        else:
            lcp[champion] = end
        node = (champion + size) >> 1
        while node:
            other = loser[node]
            a, b = lcp[champion], lcp[other]
            if a < b:
                loser[node], champion = champion, other
            elif a == b and a != end:
                x, y = key[champion], key[other]
                if y < x or y == x and other < champion:
                    lcp[champion] = width - ((x ^ y).bit_length() + 7) // 8
                    loser[node], champion = champion, other
                else:
                    lcp[other] = width - ((x ^ y).bit_length() + 7) // 8
            node >>= 1
    return runs_out, places, prefixes


def earlier(asked: list[bytes], window: int, seed: int) -> list[bytes]:
    """Answer of a bucket: for each run's entries the windows that an earlier document holds."""
    reach = window - seed
    width = reach + 1  # distances between a window's start and its anchor
    runs = [decoded(b, window, reach) for b in asked]
    sizes = [len(r[4]) for r in runs]
    keys = []
    for r in runs:
        data = r[0].tobytes()
        keys.append([int.from_bytes(data[k:k + window], "big")
                     for k in range(0, len(data), window)])
    of, place, prefix = merged(keys, [r[5].tolist() for r in runs], window)
    del keys
    begin = np.concatenate([[0], np.cumsum(sizes)])
    order = begin[np.array(of, dtype=np.int64)] + np.array(place, dtype=np.int64)
    prefix = np.array(prefix, dtype=np.int64)
    before = np.concatenate([r[1] for r in runs])[order]
    right, left, owner = (np.concatenate([r[k] for r in runs])[order] for k in (2, 3, 4))
    out = np.zeros((len(order), width), dtype=bool)
    side = np.zeros(len(order), dtype=np.uint64)  # hash of the nearest bytes to the left
    for distance in range(width):
        if distance:
            side = W.mix(side + W.CODES[1][before[:, distance - 1]])
        same = np.cumsum(prefix < window - distance)  # agree to the right of the anchor
        k = np.flatnonzero((distance <= left) & (right >= window - distance))
        if not len(k):
            continue
        by = np.lexsort((side[k], same[k]))
        k = k[by]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (same[k][1:] != same[k][:-1]) | (side[k][1:] != side[k][:-1])
        start = np.flatnonzero(new)
        smallest = np.minimum.reduceat(owner[k], start)[np.cumsum(new) - 1]
        out[k, distance] = smallest < owner[k]
    back = np.empty_like(out)
    back[order] = out
    return [R.press(np.packbits(back[a:b]).tobytes()) for a, b in zip(begin[:-1], begin[1:])]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50,
          seed: int = 16, run_bytes: int = R.RUN_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text_md5 and kept of every document.

    ``kept`` is the rest as text: a character of which a byte was removed is left out.
    """
    table = R.packed(docs, doc_id, text, run_bytes)
    n = R.buckets(docs)
    kind = docs.schema[doc_id].dataType
    id_kind = pa.int64() if kind.simpleString() == "bigint" else pa.int32()

    def seeds_of(found: Anchored, ids: np.ndarray) -> tuple[R.Values, np.ndarray]:
        """Seeds of a run, and whether it holds them in documents of several ids."""
        values = R.Values(found.seeds, n)
        low = np.full(len(values.keys), np.iinfo(np.int64).max)
        high = np.full(len(values.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, values.inverse, ids[found.of])
        np.maximum.at(high, values.inverse, ids[found.of])
        return values, low < high

    def first(row: dict) -> Iterator[pa.RecordBatch]:
        ids, texts = R.opened(row)
        values, more = seeds_of(Anchored(texts, window, seed), ids)
        yield R.questions(row["run"], values.asked(more))

    def entries(row: dict) -> tuple[np.ndarray, Anchored, np.ndarray, Entries]:
        ids, texts = R.opened(row)
        found = Anchored(texts, window, seed)
        told = R.Values(found.seeds, n).told(R.by_bucket(row["shared"]))
        picked = np.flatnonzero(told)
        return ids, found, picked, Entries(found, picked, ids, window, seed, n)

    def second(row: dict) -> Iterator[pa.RecordBatch]:
        yield R.questions(row["run"], entries(row)[3].asked())

    def last(row: dict) -> Iterator[pa.RecordBatch]:
        ids, found, picked, own = entries(row)
        bits = own.told(R.by_bucket(row["answers"]))
        at, first_, last_ = found.at[picked], found.first[picked], found.last[picked]
        later = ids[found.of[picked]] > own.owner[own.inverse]
        hits = []
        for distance in range(bits.shape[1]):
            start = at - distance
            ok = (first_ <= start) & (start <= last_) & (later | bits[own.inverse, distance])
            hits.append(start[ok])
        gone = covered(np.concatenate(hits), window, len(found.data))
        total = np.concatenate([[0], np.cumsum(gone)])
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        inner = found.edge[:-1][found.edge[:-1] < len(gone)]
        rise[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(rise)])
        a, b = found.edge[:-1], found.edge[1:]
        lost = total[b] - total[a]
        kept = [found.data[x:y][~gone[x:y]].tobytes() if k else found.data[x:y].tobytes()
                for x, y, k in zip(a.tolist(), b.tolist(), lost.tolist())]
        yield pa.RecordBatch.from_arrays(
            [R.id_column(ids, id_kind), pa.array(b - a, pa.int64()), pa.array(lost, pa.int64()),
             pa.array(spans[b] - spans[a], pa.int64()),
             pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
             pa.array([hashlib.md5(found.data[x:y]).hexdigest()
                       for x, y in zip(a.tolist(), b.tolist())], pa.string()),
             pa.array([t.decode("utf-8", "ignore") for t in kept], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_md5",
                   "kept"])

    # Answers are small and staged, so that no round is computed again for the next one.
    shared = R.staged(R.answered(R.mapped(table, first, R.ASKED), R.several), "shared")
    told = R.returned(table, shared, "shared")
    answers = R.staged(R.answered(
        R.mapped(told, second, R.ASKED), lambda asked: earlier(asked, window, seed)), "answers")
    return R.mapped(R.returned(told, answers), last,
                    f"doc_id {kind.simpleString()}, n_bytes bigint, n_removed bigint, "
                    "n_spans bigint, kept_sha256 string, text_md5 string, kept string")


def op1_suffixes(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept", "text_md5")


def cut_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts; rows left without words go.

    Rows that lose nothing stay as they are, null and empty texts too. What is cut is staged, so
    that the runs and what they shuffled are gone before ``docs`` are shuffled.
    """
    with R.scope() as folders:
        cut = R.staged(dedup(docs, doc_id, text, **options).where("n_removed > 0").select(
            F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5"),
            F.col("kept").alias("__kept")).dropDuplicates(["__id", "__md5"]), "cut")
    R.removed(docs.sparkSession, folders[:-1])
    joined = docs.join(cut, docs[doc_id].eqNullSafe(F.col("__id"))
                       & (F.md5(docs[text]) == F.col("__md5")), "left")
    whole = F.col("__md5").isNull()
    return joined.where(whole | (F.length(F.trim("__kept")) > 0)).withColumn(
        text, F.when(whole, F.col(text)).otherwise(F.col("__kept"))).drop(
        "__id", "__md5", "__kept")
