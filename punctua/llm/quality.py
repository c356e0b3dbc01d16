"""Quality classifier: naive Bayes support vectors.

A text becomes a set of indicators: hashed byte trigrams, hashed n-grams of word shapes, and the
levels of a few shape shares (repeated words, upper case, symbols). Each indicator is scaled by
its class log-count ratio, counted over all labelled training rows; a linear hinge-loss model is
then fitted to the scaled indicators by dual coordinate descent, and its margins are mapped to
probabilities by a logistic fit. Scoring reads the whole text and nothing else.

The counts cover every labelled training row. The hinge fit takes a bounded sample of distinct
labelled texts, at most about ``sample_rows`` of each class, drawn by hash.

Defined cases: null and empty texts have no indicator and get the score of the bias. Without
training rows of both classes every score is the share of label 1 (0.5 without any label).
Labels other than 0 and 1, null labels and null ids are not learned from; several labels of one
id each count once per document row. Repeated rows give repeated results.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctua.llm import runs as R
from punctua.llm import words as W
from punctua.llm.language import held_out

GRAMS = 1 << 17  # hashed byte trigrams
SHAPES = 1 << 12  # hashed n-grams of word shapes
LEVELS = 16  # levels of each share
SHARES = 6
SIZE = GRAMS + SHAPES + SHARES * LEVELS
SENT = 1_000_000  # labels of 12 bytes that may be broadcast

# Kinds of bytes: 0 other symbol, 1 upper, 2 lower or above ASCII, 3 digit, 4 sentence mark.
KIND = np.zeros(256, dtype=np.int64)
KIND[65:91], KIND[97:123], KIND[128:], KIND[48:58] = 1, 2, 2, 3
KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4


def _trigrams(data: np.ndarray) -> np.ndarray:
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    x = data.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 17)).astype(np.int64)


def indicators(text: bytes) -> np.ndarray:
    """Sorted distinct indicator numbers of a text."""
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int32)
    seen = []
    for at in range(0, len(data), W.BLOCK):  # long texts in pieces; the pieces overlap
        seen.append(np.unique(_trigrams(data[at:at + W.BLOCK + 2])))
    starts, ends, hashes = W.tokens(data)
    n = len(starts)
    if n:
        first, last = KIND[data[starts]], KIND[data[ends - 1]]
        second = KIND[data[np.minimum(starts + 1, ends - 1)]]
        length = np.minimum(ends - starts, 31) >> 2
        again = np.zeros(n, dtype=np.int64)
        again[1:] = hashes[1:] == hashes[:-1]
        shape = (((first * 5 + second) * 5 + last) * 8 + length) * 2 + again
        pair = shape[:-1] * 2003 + shape[1:] * 7 + 1
        mixed = np.unique(np.concatenate([shape, pair]).astype(np.uint64))
        seen.append(GRAMS + np.unique(W.mix(mixed) >> np.uint64(64 - 12)).astype(np.int64))
        shares = [again.mean(), ((first == 1) & (last == 1)).mean(), (last == 0).mean(),
                  ((first == 0) & (ends - starts == 1)).mean(),
                  len(np.unique(hashes)) / n, (length >= 3).mean()]
        levels = np.minimum(LEVELS - 1, (np.sqrt(shares) * LEVELS).astype(np.int64))
        seen.append(GRAMS + SHAPES + np.arange(SHARES) * LEVELS + levels)
    return np.unique(np.concatenate(seen)).astype(np.int32)


def pack(numbers: np.ndarray) -> bytes:
    return zlib.compress(np.diff(numbers, prepend=0).astype("<i4").tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), dtype="<i4"))


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(y, h, text) of the rows with a label; h is a hash of the text.

    Up to ``SENT`` labels are sent to the tasks; beyond that the rows are shuffled to them.
    """
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y")).where(
        "y IN (0, 1) AND __id IS NOT NULL")
    known = F.broadcast(known) if known.count() <= SENT else known.hint("merge")
    rows = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("text"))
    return rows.join(known, F.col("__doc") == F.col("__id")).select(
        "y", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), "text")


def described(rows: DataFrame) -> DataFrame:
    """(y, h, found) of (y, h, text); found is the packed indicators."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pack(indicators(t)) for t in W.as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), batch.column("h"), pa.array(found, pa.binary())],
                names=["y", "h", "found"])

    return rows.mapInArrow(run, "y int, h bigint, found binary")


def class_counts(rows: DataFrame, column: str = "found", numbers: Callable = unpack
                 ) -> tuple[np.ndarray, np.ndarray]:
    """(texts per class, indicators per class) over all rows; ``numbers`` tells the indicators
    of a value of ``column``.

    So texts are described and counted by one function: two in a chain would be two workers for
    each task, and idle workers keep their memory in the stages that follow.
    """
    def add(row: dict, counts: np.ndarray) -> None:
        base = row["y"] * (SIZE + 1)
        counts[base + numbers(row["value"] or b"")] += 1
        counts[base + SIZE] += 1

    values = rows.select("y", F.col(column).cast("binary").alias("value"))
    counts = R.summed(values, 2 * (SIZE + 1), add).reshape(2, -1)
    return counts[:, SIZE], counts[:, :SIZE]


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int,
                 cost: float, epochs: int, seed: int = 0) -> np.ndarray:
    """Weights of a linear L1-loss support vector machine; the last one is the bias."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        change = 0.0
        for k in rng.permutation(len(rows)):
            at, x = rows[k], values[k]
            slope = y[k] * (w[at] @ x + w[size]) - 1.0
            new = min(max(alpha[k] - slope / norm[k], 0.0), cost)
            step = (new - alpha[k]) * y[k]
            if step:
                w[at] += step * x
                w[size] += step
                change = max(change, abs(new - alpha[k]))
                alpha[k] = new
        if change < 1e-3 * cost:
            break
    return w


def logistic(margins: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset that map margins to probabilities of label 1 (Newton steps)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        weight, error = np.maximum(p * (1 - p), 1e-9), target - p
        h = np.array([[(weight * margins ** 2).sum() + 1e-6, (weight * margins).sum()],
                      [(weight * margins).sum(), weight.sum() + 1e-6]])
        step = np.linalg.solve(h, [(error * margins).sum(), error.sum()])
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


@dataclass
class Model:
    weights: np.ndarray | None  # of indicators, scaled; the last is the bias
    slope: float
    offset: float
    prior: float

    def score(self, found: np.ndarray) -> float:
        if self.weights is None:
            return self.prior
        margin = self.weights[-1]
        if len(found):
            margin = margin + self.weights[found].sum() / np.sqrt(len(found))
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35))))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", sample_rows: int = 2000, cost: float = 1.0, epochs: int = 30,
        smoothing: float = 1.0) -> Model:
    """Fit on the rows of ``docs`` that have a label; ``sample_rows`` per class at most."""
    rows = labelled(docs, labels, doc_id, text, label)
    n, counts = class_counts(rows, "text", indicators)
    total = n.sum()
    prior = float(n[1] / total) if total else 0.5
    if not n.all():
        return Model(None, 1.0, 0.0, prior)
    rate = counts + smoothing
    ratio = np.log(rate[1] / rate[1].sum()) - np.log(rate[0] / rate[0].sum())
    # Copies share a hash and are drawn once; the share follows from the class's distinct texts.
    texts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(
        F.approx_count_distinct("h").alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, sample_rows / max(1, texts[1])))).otherwise(
        F.lit(min(1.0, sample_rows / max(1, texts[0]))))
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < share)
    sample = described(drawn.dropDuplicates(["h", "y"])).orderBy("h", "y").collect()
    found = [unpack(r["found"]) for r in sample]
    y = np.array([1.0 if r["y"] == 1 else -1.0 for r in sample])
    if len(set(y)) < 2:
        return Model(None, 1.0, 0.0, prior)
    values = [ratio[f] / np.sqrt(max(1, len(f))) for f in found]
    w = dual_descent(found, values, y, SIZE, cost, epochs)
    margins = np.array([w[f] @ v + w[SIZE] for f, v in zip(found, values)])
    slope, offset = logistic(margins, y)
    return Model(np.append(w[:SIZE] * ratio, w[SIZE]), slope, offset, prior)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = R.shared(docs.sparkSession, model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = R.given(sent)
        for batch in batches:
            scores = [known.score(indicators(t)) for t in W.as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    table = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return table.mapInArrow(run, f"doc_id {kind}, score double")


def scored(docs: DataFrame, labels: DataFrame, least: float = 0.7, **names) -> DataFrame:
    """doc_id, held_out, score and predicted; learned from rows that are not held out."""
    doc_id = names.get("doc_id", "doc_id")
    model = fit(docs.where(~held_out(doc_id)), labels, **names)
    return predict(docs, model, doc_id, names.get("text", "text")).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.7, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The rows whose text scores at least ``least``, with all their columns."""
    model = fit(docs.where(~held_out(doc_id)), labels, doc_id=doc_id, text=text)
    sent = R.shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = R.given(sent)
        for batch in batches:
            texts = W.as_bytes(batch.column(text))
            yield batch.filter(pa.array(
                [known.score(indicators(t)) >= least for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                  spark.read.parquet(f"{sf_dir}/labels.parquet"))
