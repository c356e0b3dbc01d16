"""Hard negatives for anchors: angular triangle filtering.

Vectors become integers, and a score is an exact integer inner product. Rows are sorted by label,
nearest reference direction and the angle to it, and packed into windows of neighbours. A window
stores the range of its rows' angles to every reference direction and of their norms. The angles
of an anchor and the triangle inequality on the sphere then give an interval for the cosine of the
anchor with every row of a window, and with the norms an interval for the score, widened for
rounding. Only windows whose interval meets what an anchor still looks for are scored.

Anchors are a stated query set: blocks of at most ``ANCHORS`` of them are sent to all tasks, and the
windows stream past. The first pass finds an anchor's positives, the second the negatives within
the score range of each positive. Tasks keep the best few per anchor and raise the bound as they
go; the first bounds come from a sample of rows. Neither the sample nor the directions change a
result.

Defined cases: rows with a null id, label or vector, or with a component that is null or not
finite (also after scaling), take no part, nor do empty vectors and those of another length than
most (of equal shares the shorter). Rows of equal id, label and integer vector count once, as an
anchor if one of them is; rows that share an id but differ are rows of their own. Zero vectors score 0. Products that could reach 2^53 are refused. An anchor without positives or
a positive without negatives gives no row; an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctua.llm import runs as R
from punctua.session import work_path

ANCHORS = 16_384  # anchors in a block, sent to all tasks
PACK = 4096  # rows of a stored pack
WINDOW = 256  # rows of a window inside a pack
REFERENCES = 16
SAMPLE = 4096  # rows that choose the directions, and again for the first bounds
EXACT = float(1 << 53)
ANGLE_SLACK = 4e-6  # radians; angles are stored in single precision
SCORE_SLACK = 1e-9  # of the product of norms

PACKED = ("label long, n int, ids binary, ties binary, whole binary, lo binary, hi binary, "
          "norms binary")


def usable(rows: DataFrame, vec_id: str, vector: str, label: str, scale: float, anchor: Column
           ) -> DataFrame:
    """(vec_id, label, anchor, v): the rows that take part, v scaled and not yet floored."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(float(scale)))
    table = rows.select(F.col(vec_id).cast("long").alias("vec_id"),
                        F.col(label).cast("long").alias("label"),
                        F.coalesce(anchor, F.lit(False)).alias("anchor"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    table = table.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(
        (F.size("v") > 0) & ~odd)
    sizes = table.groupBy(F.size("v").alias("s")).count().orderBy(
        F.desc("count"), "s").limit(1).collect()
    return table.where(F.size("v") == (sizes[0]["s"] if sizes else 0))


def floored(column: pa.Array) -> np.ndarray:
    """Rows of integers, as float64; beyond 2^53 they would not be exact."""
    v = np.floor(np.asarray(column.flatten(), dtype=np.float64)).reshape(len(column), -1)
    if v.size and np.abs(v).max() >= EXACT:
        raise OverflowError("A vector's components are too large for exact integer scores.")
    return v


def units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms); a zero vector stays zero, at a right angle to all."""
    norms = np.sqrt((v * v).sum(axis=1))
    return v / np.where(norms > 0, norms, 1.0)[:, None], norms


def references(sample: np.ndarray) -> np.ndarray:
    """Directions that lie far from each other, from a sample of vectors."""
    u, norms = units(sample)
    u = u[norms > 0]
    if not len(u):
        return np.eye(1, sample.shape[1])
    chosen, nearest = [0], u @ u[0]
    while len(chosen) < min(REFERENCES, len(u)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, u @ u[chosen[-1]])
    return u[chosen]


def angles(v: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angles to each direction, norms)."""
    u, norms = units(v)
    return np.arccos(np.clip(u @ directions.T, -1.0, 1.0)), norms


def narrow(v: np.ndarray) -> np.ndarray:
    """The smallest integer type that holds the values."""
    most = np.abs(v).max(initial=0)
    return v.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def widened(blob: bytes, n: int, size: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<i{len(blob) // max(1, n * size)}").reshape(
        n, size).astype(np.float64)


def described(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """(vec_id, label, anchor, cell, angle, whole): nearest direction and angle to it; distinct."""
    schema = "vec_id long, label long, anchor boolean, cell int, angle double, whole binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = floored(batch.column("v"))
            found, _ = angles(v, directions)
            cell = found.argmin(axis=1)
            whole = [r.tobytes() for r in v.astype("<i4" if np.abs(v).max() < 1 << 31 else "<i8")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("anchor"),
                 pa.array(cell, pa.int32()), pa.array(found[np.arange(len(v)), cell]),
                 pa.array(whole, pa.binary())],
                names=["vec_id", "label", "anchor", "cell", "angle", "whole"])

    return rows.mapInArrow(run, schema).groupBy("vec_id", "label", "whole").agg(
        *[F.max(c).alias(c) for c in ("anchor", "cell", "angle")])


def packs(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """Staged packs of described rows, in order of label, cell and angle.

    A pack holds for each of its windows the least and greatest angle to every direction and the
    least and greatest norm. ``ties`` tells the rows of one id apart.
    """
    size = directions.shape[1]
    order = ["label", "cell", "angle", "vec_id", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def out(parts):
            table = pa.Table.from_batches(parts)
            label, cell = (table.column(c).to_numpy() for c in ("label", "cell"))
            cuts = np.flatnonzero(np.r_[True, (np.diff(label) != 0) | (np.diff(cell) != 0)])
            ids = table.column("vec_id").to_numpy().astype("<i8")
            whole = table.column("whole").to_pylist()
            for a, b in zip(cuts, [*cuts[1:], len(label)]):
                for s in range(a, b, PACK):
                    own = whole[s:min(b, s + PACK)]
                    v = np.stack([np.frombuffer(w, f"<i{len(w) // size}") for w in own])
                    ties = np.array([hash_of(w) for w in own], dtype="<u8")
                    found, norms = angles(v.astype(np.float64), directions)
                    at = np.arange(0, len(own), WINDOW)
                    lo, hi = (f.reduceat(found, at).astype("<f4") for f in (np.minimum, np.maximum))
                    spread = np.stack([f.reduceat(norms, at) for f in (np.minimum, np.maximum)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label[s]], pa.int64()), pa.array([len(own)], pa.int32()),
                         pa.array([ids[s:s + len(own)].tobytes()], pa.binary()),
                         pa.array([ties.tobytes()], pa.binary()),
                         *[pa.array([x.tobytes()], pa.binary())
                           for x in (narrow(v), lo, hi, spread)]],
                        names=["label", "n", "ids", "ties", "whole", "lo", "hi", "norms"])

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= 4 * PACK:
                yield from out(kept)
                kept = []
        if sum(b.num_rows for b in kept):
            yield from out(kept)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = rows.repartitionByRange(n, *order[:4]).sortWithinPartitions(*order)
    return R.staged(table.mapInArrow(run, PACKED), "packs")


def hash_of(blob: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(blob)


@dataclass
class Best:
    """The first ``k`` of each slot, by score and then id; slots are anchors or their positives."""

    floor: np.ndarray  # per slot, the least score that still counts
    k: int
    found: list = field(default_factory=list)
    size: int = 0

    def add(self, slot, score, ids, ties) -> None:
        if len(slot):
            self.found.append((slot, score, ids, ties))
            self.size += len(slot)
            if self.size > max(1 << 18, 4 * self.k * len(self.floor)):
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.found:
            none = np.zeros(0, dtype=np.int64)
            return none, none.astype(float), none, none.astype(np.uint64)
        rows = [np.concatenate(c) for c in zip(*self.found)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [c[order] for c in rows]
        first = np.searchsorted(rows[0], rows[0], side="left")
        place = np.arange(len(first)) - first
        last = place == self.k - 1
        self.floor[rows[0][last]] = np.maximum(self.floor[rows[0][last]], rows[1][last])
        rows = [c[place < self.k] for c in rows]
        self.found, self.size = [tuple(rows)], len(rows[0])
        return tuple(rows)


@dataclass
class Block:
    """Anchors, with what they look for: scores from ``low`` to ``high``, one slot per range."""

    ids: np.ndarray
    ties: np.ndarray
    labels: np.ndarray
    whole: np.ndarray  # narrow integers
    low: np.ndarray  # anchors x ranges; above ``high`` where there is no range
    high: np.ndarray
    same: bool  # rows of the same label, the anchor itself left out, or of other labels


class Scan:
    """Windows against a block of anchors."""

    def __init__(self, block: Block, directions: np.ndarray, k: int):
        self.block, self.directions = block, directions
        self.v = block.whole.astype(np.float64)
        self.angles, self.norms = angles(self.v, directions)
        self.most = np.abs(self.v).max(initial=0)
        self.best = Best(block.low.astype(np.float64).ravel().copy(), k)
        self.sought = (block.low <= block.high).any(axis=1)
        self.top = np.where(block.low <= block.high, block.high, -np.inf).max(axis=1)
        self.windows = self.scored = 0

    def interval(self, at: np.ndarray, lo, hi, least: float, most: float):
        """Bounds of the scores of anchors ``at`` with all rows of a window."""
        a, norm = self.angles[at], self.norms[at]
        near = np.maximum(np.maximum(lo - a, a - hi), 0.0).max(axis=1) - ANGLE_SLACK
        far = np.where(a + hi <= np.pi, a + hi, np.where(a + lo >= np.pi, 2 * np.pi - a - lo, np.pi))
        far = far.min(axis=1) + ANGLE_SLACK
        upper = np.cos(np.clip(near, 0.0, np.pi))
        lower = np.cos(np.clip(far, 0.0, np.pi))
        slack = SCORE_SLACK * norm * most + 1e-6
        return (norm * lower * np.where(lower > 0, least, most) - slack,
                norm * upper * np.where(upper > 0, most, least) + slack)

    def overlapping(self, at: np.ndarray, lo, hi, least: float, most: float) -> np.ndarray:
        """Those of the anchors ``at`` that may find a row in the window."""
        lower, upper = self.interval(at, lo, hi, least, most)
        floor = self.best.floor.reshape(self.block.low.shape)[at]
        need = np.where(floor <= self.block.high[at], floor, np.inf).min(axis=1)
        self.windows += len(at)
        at = at[(upper >= need) & (lower <= self.top[at])]
        self.scored += len(at)
        return at

    def score(self, at: np.ndarray, ids: np.ndarray, ties: np.ndarray, v: np.ndarray) -> None:
        block, best, ranges = self.block, self.best, self.block.low.shape[1]
        floor = best.floor.reshape(block.low.shape)
        for s in range(0, len(at), PACK):
            own = at[s:s + PACK]
            scores = self.v[own] @ v.T
            if block.same:
                for i in np.flatnonzero(np.isin(block.ids[own], ids)):
                    scores[i, (ids == block.ids[own[i]]) & (ties == block.ties[own[i]])] = -np.inf
            need = np.where(floor[own] <= block.high[own], floor[own], np.inf).min(axis=1)
            i, j = np.nonzero((scores >= need[:, None]) & (scores <= self.top[own][:, None])
                              & (scores > -np.inf))
            score, anchor = scores[i, j], own[i]
            for r in range(ranges):
                slot = anchor * ranges + r
                fits = (score >= best.floor[slot]) & (score <= block.high[anchor, r])
                best.add(slot[fits], score[fits], ids[j[fits]], ties[j[fits]])

    def pack(self, row: dict) -> None:
        ids, ties = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ties"], "<u8")
        v = widened(row["whole"], row["n"], self.v.shape[1])
        if self.most * np.abs(v).max() * v.shape[1] >= EXACT:
            raise OverflowError("Integer scores may reach 2^53.")
        lo, hi = (np.frombuffer(row[c], "<f4").reshape(-1, self.angles.shape[1]) for c in ("lo", "hi"))
        least, most = np.frombuffer(row["norms"], "<f8").reshape(2, -1)
        theirs = np.flatnonzero(((self.block.labels == row["label"]) == self.block.same) & self.sought)
        if not len(theirs):
            return
        for k, s in enumerate(range(0, row["n"], WINDOW)):
            at = self.overlapping(theirs, lo[k], hi[k], least[k], most[k])
            if len(at):
                self.score(at, ids[s:s + WINDOW], ties[s:s + WINDOW], v[s:s + WINDOW])


def scanned(table: DataFrame, block: Block, directions: np.ndarray, k: int, first: list[dict]
            ) -> DataFrame:
    """(slot, rank, id, score): the first ``k`` rows of ``table`` for every slot of ``block``."""
    seed = Scan(block, directions, k)
    for row in first:
        seed.pack(row)
    seed.best.settle()
    floor = seed.best.floor
    shared = table.sparkSession.sparkContext.broadcast(
        (block.__dict__, directions, floor))  # bounded by ANCHORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, refs, bound = shared.value
        scan = Scan(Block(**fields), refs, k)
        scan.best.floor = bound.copy()
        for batch in batches:
            for i in range(batch.num_rows):
                scan.pack(batch.slice(i, 1).to_pylist()[0])
        slot, score, ids, ties = scan.best.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot, pa.int64()), pa.array(score.astype(np.int64)), pa.array(ids, pa.int64()),
             pa.array(ties.view(np.int64), pa.int64())], names=["slot", "score", "id", "tie"])

    # Rows of a block's labels lie together, so other files and row groups are not read.
    labels = sorted({int(x) for x in np.unique(block.labels)})
    if block.same and len(labels) <= 100:
        table = table.where(F.col("label").isin(labels))
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id", "tie")
    return table.mapInArrow(run, "slot long, score long, id long, tie long").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding",
         label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80,
         high: int = 100, scale: float = 256.0) -> DataFrame:
    """Negatives of each anchor and positive: rows of other labels whose score is between ``low``
    and ``high`` percent of the positive's, best first.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    schema = T.StructType.fromDDL("anchor_id long, positive_id long, rank int, negative_id long, "
                                  "positive_score long, negative_score long")
    table = usable(rows, vec_id, vector, label, scale, anchor)
    n, size = table.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    drawn = F.pmod(F.xxhash64("vec_id", "label"), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE / n)
    sample = np.array([np.floor(r["v"]) for r in table.where(drawn).select("v").limit(
        4 * SAMPLE).collect()]).reshape(-1, size)
    directions = references(sample)
    table = R.staged(described(table, directions), "described")
    stored = packs(table, directions)
    first = [r.asDict() for r in packs(table.where(drawn).limit(4 * SAMPLE), directions).collect()]
    path = work_path(spark, "negatives")

    def solve(own: list[dict]) -> None:
        count = sum(r["n"] for r in own)
        ids, ties = (np.concatenate([np.frombuffer(r[c], t) for r in own])
                     for c, t in (("ids", "<i8"), ("ties", "<u8")))
        labels = np.concatenate([np.full(r["n"], r["label"]) for r in own])
        whole = narrow(np.concatenate([widened(r["whole"], r["n"], size) for r in own]))
        block = Block(ids, ties, labels, whole, np.full((count, 1), -EXACT),
                      np.full((count, 1), EXACT), True)
        pairs = scanned(stored, block, directions, positives, first).collect()
        lows, highs = np.full((count, positives), EXACT), np.full((count, positives), -EXACT)
        for r in pairs:
            lows[r["slot"], r["rank"] - 1] = -(-low * r["score"] // 100)
            highs[r["slot"], r["rank"] - 1] = high * r["score"] // 100
        block = Block(ids, ties, labels, whole, lows, highs, False)
        known = spark.createDataFrame(
            pa.table({"slot": pa.array([r["slot"] * positives + r["rank"] - 1 for r in pairs], pa.int64()),
                      "anchor_id": pa.array([int(ids[r["slot"]]) for r in pairs], pa.int64()),
                      "positive_id": pa.array([r["id"] for r in pairs], pa.int64()),
                      "positive_score": pa.array([r["score"] for r in pairs], pa.int64())}))
        got = scanned(stored, block, directions, negatives, first)
        got.join(F.broadcast(known), "slot").select(  # at most ANCHORS times positives
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")).write.mode("append").parquet(path)

    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    waiting: list[dict] = []
    for row in packs(table.where("anchor"), directions).toLocalIterator():
        if sum(r["n"] for r in waiting) + row["n"] > ANCHORS and waiting:
            solve(waiting)
            waiting = []
        waiting.append(row.asDict())
    if waiting:
        solve(waiting)
    return spark.read.schema(schema).parquet(path)


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT len(v) AS n FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
rows AS (SELECT * FROM v WHERE len(v) = (SELECT n FROM n)),
pairs AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id,
         list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON NOT (a.vec_id = r.vec_id AND a.label = r.label AND a.v = r.v)
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, p.positive_score, q.vec_id AS negative_id,
       q.score AS negative_score, (row_number() OVER w)::INTEGER AS rank
FROM positives p JOIN pairs q ON q.anchor_id = p.anchor_id AND NOT q.same
 AND 80 * p.positive_score <= 100 * q.score AND 100 * q.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY q.score DESC, q.vec_id)
QUALIFY row_number() OVER w <= 5
"""
