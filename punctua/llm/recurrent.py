"""Language-model scoring with a gated recurrent network.

Words and an end token per text are counted over all training documents; every word of the corpus
has its exact count. The network predicts the next token in two factors: the class, by a softmax
over classes, and the word within its class. The ``FREQUENT`` words with the highest counts have
vectors of their own and lie in classes of ``CLASS`` words with a softmax each. All other words
form one class per octave of their count, in which a word's share is its count plus one half; a
word that training never saw is one more member of the lowest octave, so the probabilities of the
V + 1 outcomes sum to one, as they do for the base score.

Training is truncated backpropagation through time in numpy. Every training document is used once:
in each of three rounds (1, 3 and 12 sixteenths of them) all tasks start from the same weights,
train on their own documents, and the weights are averaged by tokens, slice by slice, so that the
driver receives one set. Scoring carries the state of a document from window to window to its end.

Documents are packed into runs (``runs``). A run asks for the counts of its distinct words and
sends its own, per bucket of a hash, so a word travels once per run, however frequent it is. Words
are known by 64-bit hashes.

Defined cases: a null or empty text is the end token alone; a null id is a training document;
repeated rows count and are scored each. Without training documents N and V are 0, and every
score is 0. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctua.llm import runs as R
from punctua.llm import words as W

END = np.uint64(0x9E6C63D0676A9A99)  # stands for the end token among the hashes of words
FREQUENT = 1024
CLASS = 32
EMBED = 16
HIDDEN = 24
LANES = 512  # documents scored side by side
TRAIN_LANES = 256
STEPS = 32  # steps of a window
TOGETHER = 8_000_000  # tokens whose documents share the lanes
PIECE = 2048  # longest stretch of tokens in a training lane
ROUNDS = (1, 4, 16)  # a round ends with this sixteenth of the training documents
CUT = 16_384  # weights in a slice
CHUNK = 2048  # rows of a softmax at a time

ENCODED = ("run long, ids binary, sizes binary, tokens binary, n_known binary, base binary, "
           "tail binary")


# --- Words and counts ------------------------------------------------------------------------

def left_out(ids: np.ndarray, parts: int, remainder: int) -> np.ndarray:
    """Documents that no count and no training may see, by the crc32 of the id's text."""
    return np.array([i != R.NO_ID and zlib.crc32(str(i).encode()) % parts == remainder
                     for i in ids.tolist()], dtype=bool)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, number of tokens of each text); each text ends with ``END``."""
    parts, sizes = [], np.ones(len(texts), dtype=np.int64)
    for k, hashes in W.word_hashes(texts, lower=True):
        sizes[k] += len(hashes)
        parts += [hashes, np.array([END])]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


class Words:
    """Distinct tokens of a run and their places in buckets."""

    def __init__(self, hashes: np.ndarray, n: int):
        place, found = pd.factorize(hashes)
        order = np.argsort(found)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.keys, self.inverse = found[order], rank[place]
        bucket = (self.keys % np.uint64(n)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[self.order], prepend=-1))
        ends = [*cuts[1:], len(self.keys)]
        self.parts = [(int(bucket[self.order[a]]), self.order[a:b]) for a, b in zip(cuts, ends)]

    def asked(self, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
        for bucket, at in self.parts:
            keys = self.keys[at]
            yield bucket, R.press(np.diff(keys, prepend=np.uint64(0)).tobytes()
                                  + counts[at].astype("<u4").tobytes())

    def told(self, answers: dict[int, bytes]) -> np.ndarray:
        """The corpus count of each distinct token."""
        out = np.zeros(len(self.keys), dtype=np.int64)
        for bucket, at in self.parts:
            out[at] = np.frombuffer(R.unpress(answers[bucket]), "<i8")
        return out


def octave(counts: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1


def counted(asked: DataFrame) -> DataFrame:
    """Answers (run, bucket, asked) with corpus counts, and a row of run -1 with a bucket's sums."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for blob in map(R.unpress, frame["asked"]):
            n = len(blob) // 12
            keys.append(np.cumsum(np.frombuffer(blob, "<u8", count=n), dtype=np.uint64))
            counts.append(np.frombuffer(blob, "<u4", offset=8 * n))
        known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        own, ends = total[inverse], np.cumsum([len(k) for k in keys])
        seen = np.flatnonzero(total)
        rank = octave(total[seen])
        sums = np.zeros((64, 2), dtype="<i8")
        np.add.at(sums, rank, np.stack([np.ones_like(rank), total[seen]], axis=1))
        top = seen[np.lexsort((known[seen], -total[seen]))[:FREQUENT]]
        rows = [R.press(own[e - len(k):e].astype("<i8").tobytes()) for e, k in zip(ends, keys)]
        rows.append(sums.tobytes() + known[top].astype("<u8").tobytes()
                    + total[top].astype("<i8").tobytes())
        return pd.DataFrame({"run": [*frame["run"], -1], "asked": rows,
                             "bucket": [*frame["bucket"], frame["bucket"].iloc[0]]})

    return asked.groupBy("bucket").applyInPandas(run, R.ASKED)


@dataclass
class Counts:
    """What all tasks must know of the corpus; its size is fixed."""

    n: int  # tokens of the training documents
    v: int  # distinct ones
    top: np.ndarray  # hashes of the frequent words, most frequent first
    top_counts: np.ndarray
    octaves: np.ndarray  # octaves of other words, the lowest always
    mass: np.ndarray  # sum of count + 1/2 in each, the unseen word included

    @property
    def classes(self) -> int:
        return -(-len(self.top) // CLASS)

    def tokens(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each token, log10 of its share of its octave; 0 for frequent words)."""
        order = np.argsort(self.top)
        at = np.minimum(np.searchsorted(self.top[order], keys), max(0, len(order) - 1))
        own = (self.top[order][at] == keys) if len(order) else np.zeros(len(keys), bool)
        place = np.searchsorted(self.octaves, octave(counts))
        number = len(self.top) + np.minimum(place, len(self.octaves) - 1)
        share = np.log10((counts + 0.5) / self.mass[number - len(self.top)])
        if len(order):
            number = np.where(own, order[at], number)
        return number.astype(np.int64), np.where(own, 0.0, share)


def counts_of(answers: DataFrame) -> Counts:
    """Totals and frequent words, merged from the buckets.

    The first pass adds the sums per octave; they tell which octaves hold the frequent words, and
    the second pass sends the words of those alone.
    """
    stats = answers.where("run = -1").select("asked")

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((64, 2), dtype=np.int64)
        for batch in batches:
            for blob in batch.column("asked").to_pylist():
                sums += np.frombuffer(blob, "<i8", count=128).reshape(64, 2)
        at = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(sums[at, 0]), pa.array(sums[at, 1])],
            names=["octave", "n", "total"])

    sums = np.zeros((64, 2), dtype=np.int64)
    for r in stats.mapInArrow(sums_of, "octave int, n long, total long").groupBy("octave").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        sums[r["octave"]] = r["n"], r["total"]
    above = np.cumsum(sums[::-1, 0])[::-1]
    least = 1 << max(1, int(np.flatnonzero(above >= FREQUENT).max(initial=0)))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("asked").to_pylist():
                n = (len(blob) - 1024) // 16
                total = np.frombuffer(blob, "<i8", offset=1024 + 8 * n)
                own = total >= least
                keys = np.frombuffer(blob, "<i8", offset=1024, count=n)
                yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(total[own])],
                                                 names=["word", "total"])

    top = stats.mapInArrow(words_of, "word long, total long").orderBy(
        F.desc("total"), "word").limit(FREQUENT).collect()
    counts = np.array([r["total"] for r in top], dtype=np.int64)
    rest = sums.copy()
    np.subtract.at(rest, octave(counts), np.stack([np.ones_like(counts), counts], axis=1))
    rest[0, 0] += 1  # the word that training never saw
    octaves = np.flatnonzero(rest[:, 0])
    return Counts(int(sums[:, 1].sum()), int(sums[:, 0].sum()),
                  np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64), counts,
                  octaves, (rest[:, 1] + 0.5 * rest[:, 0])[octaves])


def encoded(table: DataFrame, answers: DataFrame, counts: Counts, n: int) -> DataFrame:
    """Staged runs of token numbers, with each document's known tokens, base score and the log10
    share of its infrequent words in their octaves."""
    fields = table.sparkSession.sparkContext.broadcast(dict(counts.__dict__))

    def run(row: dict) -> Iterator[pa.RecordBatch]:
        known = Counts(**fields.value)
        ids, texts = R.opened(row)
        hashes, sizes = tokens_of(texts)
        words = Words(hashes, n)
        corpus = words.told(R.by_bucket(row["answers"]))
        number, share = known.tokens(words.keys, corpus)
        base = np.log10((corpus + 0.5) / (known.n + 0.5 * (known.v + 1)))
        first = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(x[words.inverse], first) for x in (
            (corpus > 0).astype(np.int64), base, share)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["run"]], pa.int64()), *[pa.array([x], pa.binary()) for x in (
                row["ids"], sizes.tobytes(), R.press(number[words.inverse].astype("<u2").tobytes()),
                *[s.tobytes() for s in sums])]],
            names=["run", "ids", "sizes", "tokens", "n_known", "base", "tail"])

    told = R.returned(table, answers.where("run >= 0"))
    return R.staged(R.mapped(told, run, ENCODED), "encoded", rows_of_mb=True)


# --- The network -----------------------------------------------------------------------------

def _sigmoids(x: np.ndarray) -> None:
    """1 / (1 + exp(x)) in place; a large x gives 0."""
    np.exp(x, out=x)
    x += 1.0
    np.reciprocal(x, out=x)


class Network:
    """Weights as views of one vector, so that they can be averaged and sent."""

    def __init__(self, counts: Counts, flat: np.ndarray | None = None):
        self.words, self.classes = len(counts.top), counts.classes
        self.outputs = self.classes + len(counts.octaves)
        self.start = self.words + len(counts.octaves)
        shapes = {"embed": (self.start + 1, EMBED), "wx": (EMBED, 3 * HIDDEN), "bx": (3 * HIDDEN,),
                  "ug": (HIDDEN, 2 * HIDDEN), "uc": (HIDDEN, HIDDEN),
                  "wc": (HIDDEN, self.outputs), "bc": (self.outputs,),
                  "ww": (self.classes * CLASS, HIDDEN), "bw": (self.classes * CLASS,)}
        self.size = sum(int(np.prod(s)) for s in shapes.values())
        fresh = flat is None
        self.flat = np.zeros(self.size, np.float32) if fresh else flat.astype(np.float32)
        self.w, at = self.views(self.flat, shapes), 0
        self.shapes = shapes
        self.rooms: dict[str, np.ndarray] = {}
        if fresh:
            rng = np.random.Generator(np.random.PCG64(11))
            for name in ("embed", "wx", "ug", "uc"):
                shape = shapes[name]
                self.w[name][:] = rng.normal(size=shape) / np.sqrt(shape[-1] if name == "embed" else shape[0])
            # Before training the outputs are the shares of classes and words.
            weight = np.zeros(self.classes * CLASS)
            weight[:self.words] = counts.top_counts + 0.5
            mass = np.r_[weight.reshape(-1, CLASS).sum(axis=1), counts.mass]
            self.w["bc"][:] = np.log(mass / mass.sum())
            self.w["bw"][:] = np.where(weight > 0, np.log(np.maximum(weight, 0.5)), -1e9)

    @staticmethod
    def views(flat: np.ndarray, shapes: dict) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            out[name] = flat[at:at + size].reshape(shape)
            at += size
        return out

    def room(self, name: str, shape: tuple, dtype) -> np.ndarray:
        """An array for one window, whose memory the next window takes again: to get fresh memory
        for each costs a fifth of the training."""
        size, own = int(np.prod(shape)), self.rooms.get(name)
        if own is None or own.size < size or own.dtype != dtype:
            own = self.rooms[name] = np.empty(size, dtype)
        return own[:size].reshape(shape)

    def steps(self, inputs: np.ndarray, state: np.ndarray, table: list[np.ndarray],
              keep: bool = False):
        """States after each step; ``inputs`` is steps x lanes, a start clears a lane's state.

        Gates lie in arrays of their own, kept for the gradient. What is returned but the last
        state holds until the next call."""
        h, (of_z, of_r, of_c) = state, table
        uz, ur = (np.ascontiguousarray(-u) for u in np.split(self.w["ug"], 2, axis=1))
        out = self.room("out", (*inputs.shape, HIDDEN), state.dtype)
        held = self.room("held", (5, len(inputs) if keep else 1, *state.shape), state.dtype)
        clear = inputs == self.start
        before = np.seterr(over="ignore")
        for t, any_clear in enumerate(clear.any(axis=1).tolist()):
            own = inputs[t]
            if any_clear:
                h = h.copy()
                h[clear[t]] = 0.0
            was, z, r, rh, c = held[:, t if keep else 0]
            if keep:
                was[:] = h
            np.matmul(h, uz, out=z)
            z += of_z.take(own, axis=0)
            _sigmoids(z)
            np.matmul(h, ur, out=r)
            r += of_r.take(own, axis=0)
            _sigmoids(r)
            np.multiply(r, h, out=rh)
            np.matmul(rh, self.w["uc"], out=c)
            c += of_c.take(own, axis=0)
            np.tanh(c, out=c)
            h = np.subtract(h, c, out=out[t])
            h *= z
            h += c
        np.seterr(**before)
        return out, h.copy(), held

    def classed(self, targets: np.ndarray) -> np.ndarray:
        return np.where(targets < self.words, targets // CLASS, targets - self.words + self.classes)

    def logs(self, states: np.ndarray, targets: np.ndarray, slopes: dict | None = None):
        """Natural logs of the probabilities of ``targets`` after ``states`` (rows).

        With ``slopes`` the gradient of their negative mean is added there, and the gradient by
        ``states`` is returned too.
        """
        w, n = self.w, len(targets)
        classes = self.classed(targets)
        order = np.argsort(classes.astype(np.uint16), kind="stable")
        classes, targets, states = classes[order], targets[order], states.take(order, axis=0)
        found, back = np.zeros(n), None if slopes is None else np.empty_like(states)

        def softmax(at: slice, weights: np.ndarray, bias: np.ndarray, own: np.ndarray):
            """Adds the logs of ``own``; returns the gradient by the logits."""
            logits = states[at] @ weights
            logits += bias
            cells = np.arange(0, logits.size, logits.shape[1]) + own
            mine = logits.take(cells)
            if not -50.0 < mine.min() or not logits.max() < 50.0:
                logits -= logits.max(axis=1, keepdims=True)
                mine = logits.take(cells)
            total = np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype)
            found[at] += mine - np.log(total)
            if slopes is None:
                return None
            total *= n
            logits *= np.reciprocal(total, out=total)[:, None]
            logits.reshape(-1)[cells] -= 1.0 / n
            return logits

        for a in range(0, n, CHUNK):  # pieces that stay in the cache
            at = slice(a, min(n, a + CHUNK))
            d = softmax(at, w["wc"], w["bc"], classes[at])
            if d is not None:
                slopes["wc"] += states[at].T @ d
                slopes["bc"] += d.sum(axis=0)
                back[at] = d @ w["wc"].T
        cuts = np.searchsorted(classes, np.arange(self.classes + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(k * CLASS, (k + 1) * CLASS)
            for a in range(cuts[k], cuts[k + 1], CHUNK):
                at = slice(a, min(cuts[k + 1], a + CHUNK))
                d = softmax(at, w["ww"][own].T, w["bw"][own], targets[at] - k * CLASS)
                if d is not None:
                    slopes["ww"][own] += d.T @ states[at]
                    slopes["bw"][own] += d.sum(axis=0)
                    back[at] += d @ w["ww"][own]
        out, inverse = np.empty(n), np.empty(n, np.int64)
        out[order] = found
        inverse[order] = np.arange(n)
        return out, None if back is None else back.take(inverse, axis=0)

    def table(self) -> list[np.ndarray]:
        """What each token adds to each gate, with the sign that ``steps`` takes."""
        x = self.w["embed"] @ self.w["wx"] + self.w["bx"]
        x[:, :2 * HIDDEN] *= -1.0
        return [np.ascontiguousarray(part) for part in np.split(x, 3, axis=1)]

    def slopes(self, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray):
        """(gradient, state): truncated backpropagation through one window; targets below 0 are
        no tokens."""
        w = self.w
        flat = np.zeros(self.size, np.float32)
        g = self.views(flat, self.shapes)
        out, last, held = self.steps(inputs, state, self.table(), keep=True)
        real = targets >= 0
        back = self.room("back", out.shape, out.dtype)
        back[:] = 0.0
        _, back[real] = self.logs(out[real], targets[real], g)
        dx = self.room("dx", (3, *out.shape), out.dtype)  # by what each gate adds up
        dh = np.zeros_like(state)
        uzt, urt, uct = (np.ascontiguousarray(u.T) for u in (
            *np.split(w["ug"], 2, axis=1), w["uc"]))
        clear = inputs == self.start
        any_clear = clear.any(axis=1).tolist()
        for t in range(len(inputs) - 1, -1, -1):
            h, z, r, rh, c = held[:, t]
            dz, dr, dc = dx[:, t]
            dh += back[t]
            keep = dh * z
            np.subtract(dh, keep, out=dc)
            np.subtract(h, c, out=dz)
            c *= c
            dc *= np.subtract(1.0, c, out=c)
            drh = dc @ uct
            dz *= keep
            dz *= np.subtract(1.0, z, out=z)
            drh *= r
            np.multiply(drh, h, out=dr)
            dr *= np.subtract(1.0, r, out=r)
            dh = np.matmul(dz, uzt, out=dh)
            dh += dr @ urt
            dh += keep
            dh += drh
            if any_clear[t]:
                dh[clear[t]] = 0.0
        was, _, _, rh, _ = held.reshape(5, -1, HIDDEN)
        tokens = inputs.ravel()
        read, ones = w["embed"][tokens].T, np.ones(len(tokens), out.dtype)
        pulls = np.zeros((len(tokens), EMBED), out.dtype)
        for k, part in enumerate(dx.reshape(3, -1, HIDDEN)):
            own = slice(k * HIDDEN, (k + 1) * HIDDEN)
            (g["uc"] if k == 2 else g["ug"][:, own])[:] += (rh if k == 2 else was).T @ part
            g["bx"][own] += ones @ part
            g["wx"][:, own] += read @ part
            pulls += part @ w["wx"][:, own].T
        for k in range(EMBED):
            g["embed"][:, k] += np.bincount(tokens, weights=pulls[:, k], minlength=self.start + 1)
        return flat, last


def lanes_of(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Pieces dealt to lanes, longest first, each to the shortest lane; longest lane first."""
    heap = [(0, k) for k in range(min(lanes, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-sizes, kind="stable").tolist():
        total, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (total + int(sizes[i]), k))
    return sorted(out, key=lambda own: -sum(int(sizes[i]) for i in own))


def windows(tokens: np.ndarray, first: np.ndarray, sizes: np.ndarray, lanes: int, start: int
            ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, places of the targets): steps x lanes, lanes that have ended are left
    away. The input of a piece's first token is ``start``; targets of -1 are no tokens."""
    dealt = lanes_of(sizes, lanes)
    places = [np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in own]) for own in dealt]
    begins = np.zeros(len(tokens), dtype=bool)
    begins[first] = True
    lengths = np.array([len(p) for p in places])
    for at in range(0, int(lengths.max(initial=0)), STEPS):
        live = int((lengths > at).sum())
        steps = int(min(STEPS, lengths[0] - at))
        place = np.full((steps, live), -1, dtype=np.int64)
        for k in range(live):
            own = places[k][at:at + STEPS]
            place[:len(own), k] = own
        real = place >= 0
        inputs = np.where(real & ~begins[place], tokens[place - 1], start)
        yield inputs, np.where(real, tokens[place], -1), place


def trained(network: Network, tokens: np.ndarray, sizes: np.ndarray, moments: dict,
            rate: float = 0.01) -> int:
    """Adam steps over documents; returns the number of tokens."""
    first = np.cumsum(sizes) - sizes
    pieces = [(a + s, min(PIECE, n - s)) for a, n in zip(first.tolist(), sizes.tolist())
              for s in range(0, n, PIECE)]
    if not pieces:
        return 0
    first, sizes = (np.array(x, dtype=np.int64) for x in zip(*pieces))
    state = np.zeros((0, HIDDEN), np.float32)
    for inputs, targets, _ in windows(tokens, first, sizes, TRAIN_LANES, network.start):
        live = inputs.shape[1]
        state = state[:live] if len(state) >= live else np.zeros((live, HIDDEN), np.float32)
        g, state = network.slopes(inputs, targets, state)
        g *= min(1.0, 1.0 / (float(np.sqrt(g @ g)) + 1e-9))
        moments["n"] += 1
        moments["m"] += 0.1 * (g - moments["m"])
        moments["v"] += 0.01 * (g * g - moments["v"])
        n = moments["n"]
        network.flat -= rate * (moments["m"] / (1 - 0.9 ** n)) / (
            np.sqrt(moments["v"] / (1 - 0.99 ** n)) + 1e-6)
    return int(sizes.sum())


def likelihoods(network: Network, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of every document, its state carried to its end."""
    first, out = np.cumsum(sizes) - sizes, np.zeros(len(tokens))
    table, state = network.table(), np.zeros((0, HIDDEN), np.float32)
    for inputs, targets, place in windows(tokens, first, sizes, LANES, network.start):
        live = inputs.shape[1]
        state = state[:live] if len(state) >= live else np.zeros((live, HIDDEN), np.float32)
        states, state, _ = network.steps(inputs, state, table)
        real = targets >= 0
        out[place[real]] = network.logs(states[real], targets[real])[0]
    return np.add.reduceat(out, first) if len(sizes) else out


# --- Rounds of training, and scores -------------------------------------------------------------

def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(row["ids"], np.int64),
            np.frombuffer(R.unpress(row["tokens"]), "<u2").astype(np.int64),
            np.frombuffer(row["sizes"], np.int64))


def averaged(table: DataFrame, counts: Counts, flat: np.ndarray, begin: int, end: int, parts: int,
             remainder: int) -> np.ndarray:
    """Weights after a round: each task trains from ``flat`` on its documents of the sixteenths
    from ``begin`` to ``end``; the mean by tokens is taken per slice, so the driver gets one set.

    As in scoring, runs share their lanes: a run's few documents of a small round would leave most
    lanes empty beside the longest."""
    shared = table.sparkSession.sparkContext.broadcast((dict(counts.__dict__), flat))
    schema = "slice int, tokens double, weights binary"

    def batch_of(slices: dict[int, tuple[float, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(slices), pa.int32()), pa.array([n for n, _ in slices.values()], pa.float64()),
             pa.array([x.astype("<f4").tobytes() for _, x in slices.values()], pa.binary())],
            names=["slice", "tokens", "weights"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, weights = shared.value
        network, seen = Network(Counts(**fields), weights), 0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        moments = {"n": 0, "m": np.zeros(network.size, np.float32), "v": np.zeros(network.size, np.float32)}
        for batch in batches:
            for k in range(batch.num_rows):
                ids, tokens, sizes = _unpacked(batch.slice(k, 1).to_pylist()[0])
                part = np.array([zlib.crc32(b"%d" % i) // parts % 16 for i in ids.tolist()])
                own = (part >= begin) & (part < end) & ~left_out(ids, parts, remainder)
                waiting.append((tokens[np.repeat(own, sizes)], sizes[own]))
                if sum(len(t) for t, _ in waiting) >= TOGETHER:
                    seen += trained(network, *map(np.concatenate, zip(*waiting)), moments)
                    waiting = []
        if waiting:
            seen += trained(network, *map(np.concatenate, zip(*waiting)), moments)
        if seen:
            yield batch_of({k: (float(seen), network.flat[c:c + CUT])
                            for k, c in enumerate(range(0, network.size, CUT))})

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for k, n, blob in zip(*(batch.column(c).to_pylist() for c in ("slice", "tokens", "weights"))):
                old, x = sums.get(k, (0.0, 0.0))
                sums[k] = old + n, x + n * np.frombuffer(blob, "<f4").astype(np.float64)
        if sums:
            yield batch_of({k: (n, x / n) for k, (n, x) in sums.items()})

    out = flat.copy()
    rows = table.select("ids", "sizes", "tokens").mapInArrow(train, schema).repartition(
        "slice").mapInArrow(mean, schema)
    for r in rows.collect():
        out[r["slice"] * CUT:(r["slice"] + 1) * CUT] = np.frombuffer(r["weights"], "<f4")
    return out


def scored(table: DataFrame, counts: Counts, flat: np.ndarray, parts: int, remainder: int
           ) -> DataFrame:
    """Scores of all documents. Runs of about ``TOGETHER`` tokens share their lanes, so that a long
    document runs beside many others."""
    shared = table.sparkSession.sparkContext.broadcast((dict(counts.__dict__), flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, weights = shared.value
        known = Counts(**fields)
        network = Network(known, weights)
        waiting: list[tuple] = []

        def out():
            ids, tokens, sizes, n_known, base, tail = (np.concatenate(c) for c in zip(*waiting))
            logs = likelihoods(network, tokens, sizes)
            return pa.RecordBatch.from_arrays(
                [R.id_column(ids, pa.int64()), pa.array(left_out(ids, parts, remainder)),
                 pa.array(sizes), pa.array(n_known), pa.array(np.full(len(ids), known.n, np.int64)),
                 pa.array(base), pa.array(logs / np.log(10.0) + tail)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                       "score"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                waiting.append((*_unpacked(row), *(np.frombuffer(row[c], t) for c, t in (
                    ("n_known", "<i8"), ("base", "<f8"), ("tail", "<f8")))))
                if sum(len(w[1]) for w in waiting) >= TOGETHER:
                    yield out()
                    waiting = []
        if waiting:
            yield out()

    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")
    return table.mapInArrow(run, schema)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 5,
                    remainder: int = 1) -> DataFrame:
    """Base and model log10-likelihood of every document; learned from documents whose crc32 of
    the id's text does not leave ``remainder`` in a division by ``parts``."""
    table, n = R.packed(docs, doc_id, text, in_buckets=True), R.buckets(docs)

    def ask(row: dict) -> Iterator[pa.RecordBatch]:
        ids, texts = R.opened(row)
        hashes, sizes = tokens_of(texts)
        words = Words(hashes, n)
        learned = np.repeat(~left_out(ids, parts, remainder), sizes)
        counts = np.bincount(words.inverse[learned], minlength=len(words.keys))
        yield R.questions(row["run"], words.asked(counts))

    answers = R.staged(counted(R.mapped(table, ask, R.ASKED)), "answers")
    counts = counts_of(answers)
    numbers = encoded(table, answers, counts, n)
    flat, begin = Network(counts).flat, 0
    for end in ROUNDS:
        flat, begin = averaged(numbers, counts, flat, begin, end, parts, remainder), end
    return scored(numbers, counts, flat, parts, remainder)


def op13_recurrent(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
