"""Best-fit packing of documents into training sequences, with conflicts.

A document of n words is cut into pieces of at most ``capacity`` words. Pieces go into bins of
``capacity`` words, longest first. A bin carries two bitmaps, of the sources and of the
duplicate clusters of its pieces; a bin may hold one document of a source and one of a cluster
only (``one_source=False`` lifts the first rule). Bins are kept in order of what is left in
them: the search starts at the smallest remainder that holds the piece and goes on to the next
larger until a compatible bin is found, so a piece lands in the tightest compatible bin, the
oldest among equals.

Pieces are dealt to shards by hash, about ``shard_pieces`` in each, and every shard packs its own
pieces: work and memory per task are bounded whatever the size of the table, and a source or
a cluster with a third of all rows is spread like any other. Only ids and lengths are shuffled.

Defined cases: words are `[^\\x20\\x09-\\x0D]+`; a document without words (null, empty) makes one
piece of no words, which fits anywhere but for conflicts. A null source conflicts with nothing.
Exact copies (equal texts) are one cluster; a null or empty text conflicts with nothing.
Repeated rows are packed once per row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctua.llm import runs as R
from punctua.llm import words as W


class Bins:
    """Open bins by remaining words; bit r of ``free`` tells that some bin has r words left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.free = 0
        # remaining words -> (sources, clusters) bitmaps -> bins, oldest first
        self.by_rest: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.state: list[tuple[int, int, int]] = []  # of each bin: rest, sources, clusters
        self.items: list[int] = []  # pieces in each bin

    def _put(self, number: int, state: tuple[int, int, int]) -> None:
        rest, sources, clusters = state
        self.by_rest.setdefault(rest, {}).setdefault((sources, clusters), []).append(number)
        self.free |= 1 << rest
        self.state[number] = state

    def _take(self, number: int) -> None:
        rest, sources, clusters = self.state[number]
        level = self.by_rest[rest]
        same = level[sources, clusters]
        same.remove(number)
        if not same:
            del level[sources, clusters]
            if not level:
                del self.by_rest[rest]
                self.free &= ~(1 << rest)

    def add(self, n: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, position in it) of a piece; source and cluster are bits, 0 for none."""
        above = self.free >> n << n
        while above:
            rest = (above & -above).bit_length() - 1
            found = [bins[0] for (s, c), bins in self.by_rest[rest].items()
                     if not s & source and not c & cluster]
            if found:
                number = min(found)
                _, s, c = self.state[number]
                self._take(number)
                break
            above &= above - 1  # the successor
        else:
            number, rest, s, c = len(self.state), self.capacity, 0, 0
            self.state.append((rest, 0, 0))
            self.items.append(0)
        self._put(number, (rest - n, s | source, c | cluster))
        self.items[number] += 1
        return number, self.items[number] - 1


def pack_shard(pieces: list[tuple], capacity: int, one_source: bool = True) -> list[tuple[int, int]]:
    """(bin, position) of every piece; a piece is (n_words, doc_id, start, source, cluster).

    Order: longest first, then smallest id, start, source and cluster.
    """
    clusters: dict[object, int] = {}
    for piece in pieces:
        if piece[4] is not None:
            clusters[piece[4]] = clusters.get(piece[4], 0) + 1
    bit_of = {c: 1 << k for k, c in enumerate(c for c, n in clusters.items() if n > 1)}
    sources: dict[object, int] = {}
    out: list = [None] * len(pieces)
    bins = Bins(capacity)
    order = sorted(range(len(pieces)), key=lambda k: (
        -pieces[k][0], pieces[k][1] is None, pieces[k][1] if pieces[k][1] is not None else 0,
        pieces[k][2], str(pieces[k][3]), str(pieces[k][4])))
    for k in order:
        n, _, _, source, cluster = pieces[k]
        bit = 0
        if one_source and source is not None:
            bit = sources.setdefault(source, 1 << len(sources))
        out[k] = bins.add(n, bit, bit_of.get(cluster, 0))
    return out


def lengths(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """doc_id, source, cluster and n_words of every row."""
    table = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                        F.when(F.length(text) > 0, F.md5(F.col(text))).alias("cluster"),
                        F.col(text).alias("text"))
    kept = ["doc_id", "source", "cluster"]
    fields = [T.StructField(c, table.schema[c].dataType) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(h) for _, h in W.word_hashes(W.as_bytes(batch.column("text")), False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(counts, pa.int64())],
                names=[*kept, "n_words"])

    return table.mapInArrow(run, T.StructType([*fields, T.StructField("n_words", T.LongType())]))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         capacity: int = 2048, one_source: bool = True, shard_pieces: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, source, cluster, bin_id, position.

    ``bin_id`` is shard x 2^32 + number, unique over the table.
    """
    table = R.staged(lengths(docs, doc_id, text, source), "lengths")
    cuts = F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(capacity))
    pieces = table.withColumn("first_word", F.explode(cuts)).select(
        "doc_id", (F.col("first_word") / capacity).cast("int").alias("piece"),
        F.col("first_word").cast("long").alias("first_word"),
        F.least(F.lit(capacity), F.col("n_words") - F.col("first_word")).alias("n_words"),
        "source", "cluster")
    n = table.agg(F.sum(F.ceil(F.greatest(F.col("n_words"), F.lit(1)) / capacity))).first()[0]
    shards = max(1, round((n or 0) / shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(
        F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)).cast("long"))
    schema = T.StructType([f for f in pieces.schema]
                          + [T.StructField("bin_id", T.LongType()),
                             T.StructField("position", T.IntegerType())])
    columns = [f.name for f in schema]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = list(zip(*[table.column(c).to_pylist() for c in (
            "n_words", "doc_id", "first_word", "source", "cluster")]))
        placed = pack_shard(rows, capacity, one_source)
        shard = key[0].as_py() << 32
        table = table.append_column("bin_id", pa.array([shard + b for b, _ in placed], pa.int64()))
        table = table.append_column("position", pa.array([p for _, p in placed], pa.int32()))
        return table.select(columns)  # ids keep their type, beside a null as well

    return dealt.groupBy("shard").applyInArrow(run, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
