"""Approximate nearest neighbours by largest inner product: multi-index hashing.

A rotation is learned on a bounded sample (principal axes, then alternating sign codes and
orthogonal fits); the signs of a rotated vector are its binary code. A code is split into
substrings, and each shard of rows indexes every substring. Codes within Hamming radius R of a
query agree with it within R // m bits in one of m substrings (pigeonhole), so probing all
substrings within that radius retrieves every code within R. The radius of a query grows until at
least ``rerank`` codes lie within it (or all rows do), and these are reranked by the inner product
of the original vectors in double precision.

Every row is indexed; rows are dealt to shards by hash, so equal vectors spread. Queries go to
the shards in blocks, and each shard returns its best k per query block; the best k of all
shards are the answer. Norms count: vectors are indexed with one more component that makes all
norms equal, which turns the largest inner product into the smallest angle.

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold
null or non-finite components take no part. Fewer than k candidates give all of them. Ties go
to the smaller vec_id; a query is no candidate of its own, a row with the same id neither.
Null ids take no part. Repeated rows count once: equal queries (id and vector) have one answer,
and equal rows are one candidate. Queries of one id with several vectors have one answer too: the
best k of all of them, each candidate by its best score.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass
class Code:
    """Rotation of (vector, norm complement) to ``bits`` signs, cut into substrings."""

    mean: np.ndarray
    rotation: np.ndarray
    top: float  # largest squared norm
    substrings: int
    width: int  # bits in a substring

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - (x ** 2).sum(1), 0.0))
        return np.column_stack([x, rest])

    def signs(self, x: np.ndarray) -> np.ndarray:
        """Substring values, one column for each substring."""
        bits = (x - self.mean) @ self.rotation > 0
        weight = (1 << np.arange(self.width)).astype(np.int64)
        return bits.reshape(len(x), self.substrings, self.width) @ weight


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part, with their number of components."""
    return vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    ).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(_checked()).withColumn(
        "d", F.size("v"))


def _checked():
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False))


def fit(rows: DataFrame, dim: int, sample_rows: int = 8192, bits: int = 64, substrings: int = 8,
        rounds: int = 30) -> Code | None:
    """Learn the rotation on about ``sample_rows`` distinct vectors, drawn by hash."""
    kept = rows.where(F.col("d") == dim)
    h = F.xxhash64(F.col("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, top = kept.agg(F.approx_count_distinct(h), F.max(norm)).first()
    if not n:
        return None
    drawn = kept.where(F.pmod(h, F.lit(1 << 30)) / float(1 << 30) < min(1.0, sample_rows / n))
    sample = drawn.groupBy(h.alias("h")).agg(F.first("v").alias("v")).orderBy("h").collect()
    x = np.array([r["v"] for r in sample] or [[1.0] * dim])
    code = Code(np.zeros(dim + 1), np.zeros((dim + 1, bits)), float(top), substrings,
                bits // substrings)
    x = code.lifted(x)
    code.mean = x.mean(0)
    x = x - code.mean
    axes = np.linalg.eigh(x.T @ x)[1].T[::-1]
    rng = np.random.Generator(np.random.PCG64(7))
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    if bits <= dim + 1:
        basis = axes[:bits].T
    else:  # more bits than axes: random directions beside the principal ones
        basis = np.column_stack([axes.T, rng.standard_normal((dim + 1, bits - dim - 1))])
    y = x @ basis
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(y @ turn).T @ y)
        turn = (u @ w).T
    code.rotation = basis @ turn
    return code


def masks(width: int) -> list[np.ndarray]:
    """For each number of flipped bits, all masks of that many bits."""
    return [np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), r)],
                     dtype=np.int64) for r in range(width + 1)]


def packed_words(parts: np.ndarray, width: int) -> np.ndarray:
    """Codes as 64-bit words, one row for each word."""
    each = 64 // width
    out = []
    for a in range(0, parts.shape[1], each):
        word = np.zeros(len(parts), dtype=np.uint64)
        for k, s in enumerate(range(a, min(a + each, parts.shape[1]))):
            word |= parts[:, s].astype(np.uint64) << np.uint64(k * width)
        out.append(word)
    return np.stack(out)


class Shard:
    """Substring indexes over the codes of some rows."""

    def __init__(self, code: Code, ids: np.ndarray, x: np.ndarray):
        self.code, self.ids, self.x = code, ids, x
        parts = code.signs(code.lifted(x))
        order = np.argsort(parts, axis=0, kind="stable")
        size = 1 << code.width
        # Rows of substring s with value v: rows[first[s, v]:first[s, v + 1]].
        self.rows = order.T.ravel()
        self.first = np.stack([
            s * len(ids) + np.searchsorted(parts[order[:, s], s], np.arange(size + 1))
            for s in range(code.substrings)])
        self.parts = parts
        self.words = packed_words(parts, code.width)
        self.masks = masks(code.width)
        self.some = np.unique(np.linspace(0, len(ids) - 1, 512).astype(np.int64))

    def distances(self, rows: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        """Hamming distances of the rows' codes."""
        own = packed_words(query[None, :], self.code.width)[:, 0]
        return sum(np.bitwise_count(w[rows] ^ q).astype(np.int16) for w, q in zip(self.words, own))

    def probed(self, query: np.ndarray, flipped: np.ndarray) -> np.ndarray:
        """Rows of all substrings whose value is the query's under one of the masks."""
        values = query[:, None] ^ flipped
        part = np.arange(len(query))[:, None]
        begin, end = self.first[part, values].ravel(), self.first[part, values + 1].ravel()
        count = end - begin
        before = np.cumsum(count) - count
        return self.rows[np.repeat(begin - before, count) + np.arange(count.sum())]

    def within(self, query: np.ndarray, least: int) -> np.ndarray:
        """Rows within the smallest Hamming radius that holds ``least`` of them; else all.

        Some rows tell about how large that radius is. Where the probes for it would give more
        than half of the rows, all codes are compared instead.
        """
        m, n = self.code.substrings, len(self.ids)
        least = min(least, n)
        guess = np.quantile(self.distances(self.some, query), least / n)
        rows = np.zeros(0, dtype=np.int64)
        for near in range(self.code.width + 1):  # radius of the substrings
            radius = m * (near + 1) - 1  # all codes within it have been probed then
            if m * len(self.masks[near]) >= n or guess > radius and self._many(query, near + 1):
                break
            rows = np.union1d(rows, self.probed(query, self.masks[near]))
            far = self.distances(rows, query)
            if np.count_nonzero(far <= radius) >= least:
                return rows[far <= np.partition(far, least - 1)[least - 1]]
        far = self.distances(slice(None), query)
        return np.flatnonzero(far <= np.partition(far, least - 1)[least - 1])

    def _many(self, query: np.ndarray, near: int) -> bool:
        """Whether substrings within radius ``near`` hold more than half as many entries as rows."""
        values = query[:, None] ^ np.concatenate(self.masks[:near + 1])
        part = np.arange(len(query))[:, None]
        return (self.first[part, values + 1] - self.first[part, values]).sum() > len(self.ids) // 2

    def best(self, q_id: int, q: np.ndarray, part: np.ndarray, k: int, least: int
             ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows for one query."""
        rows = self.within(part, least + 1)
        rows = rows[self.ids[rows] != q_id]
        scores = self.x[rows] @ q
        order = np.lexsort((self.ids[rows], -scores))
        order = order[np.sort(np.unique(self.ids[rows][order], return_index=True)[1])[:k]]
        return self.ids[rows][order], scores[order]


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id",
           vector: str = "embedding", k: int = 20, rerank: int = 2000, shard_rows: int = 16384,
           block_rows: int = 1024, **learned) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``vectors`` for each query."""
    schema = "query_id bigint, vec_id bigint, score double"
    rows, asked = usable(vectors, vec_id, vector), usable(queries, vec_id, vector)
    sizes = rows.groupBy("d").count().orderBy(F.desc("count"), "d").collect()
    spark = vectors.sparkSession
    code = fit(rows, sizes[0]["d"], **learned) if sizes else None
    if code is None:
        found = spark.createDataFrame([], schema)
        return found.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    dim, n = sizes[0]["d"], sizes[0]["count"]
    shards = math.ceil(n / shard_rows)
    queried = asked.where(F.col("d") == dim).dropDuplicates(["vec_id", "v"])
    blocks = max(1, math.ceil(queried.count() / block_rows))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n)).cast("int")
    # Rows go once to each query block and queries once to each shard: blocks against blocks.
    left = rows.where(F.col("d") == dim).select(
        deal(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "vec_id", "v")
    right = queried.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        deal(blocks).alias("block"), "vec_id", "v")

    def run(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asking):
            own = own.sort_values("vec_id", kind="stable")
            ids, x = own["vec_id"].to_numpy(), np.stack(own["v"].to_numpy())
            if len(np.unique(ids)) < len(ids):  # equal rows count once
                first = np.sort(np.unique(np.column_stack([ids.view(np.float64), x]).view(
                    f"V{8 * (dim + 1)}").ravel(), return_index=True)[1])
                ids, x = ids[first], x[first]
            shard = Shard(code, ids, x)
            q = np.stack(asking["v"].to_numpy())
            parts = code.signs(code.lifted(q))
            out = [shard.best(*one, k, rerank) for one in zip(asking["vec_id"], q, parts)]
        ids = np.concatenate([np.zeros(0, dtype=np.int64), *[i for i, _ in out]])
        scores = np.concatenate([np.zeros(0), *[s for _, s in out]])
        counts = [len(i) for i, _ in out]
        best = pd.DataFrame({"query_id": np.repeat(asking["vec_id"].to_numpy()[:len(out)], counts),
                             "vec_id": ids, "score": scores})
        if asking["vec_id"].is_unique:
            return best
        return best.sort_values("score", ascending=False, kind="stable").drop_duplicates(
            ["query_id", "vec_id"])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
