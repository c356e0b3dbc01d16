"""Documents packed into runs, and questions that runs ask each other.

A run is one row with some MB of neighbouring documents. Operators on repeated text emit, per run
and bucket of a hash, one row of sorted packed values; a task per bucket compares the runs and
answers each with a bit per value; the answers return to their run. So a value travels once per
run, however often it occurs there, and no group of rows is ever gathered by one key.

The number of buckets follows spark.sql.shuffle.partitions: set it so that a bucket's share of
the values fits a task.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.llm import words as W
from punctua.session import work_path

RUN_BYTES = 8 << 20
RUN_TEXTS = 1 << 20
NO_ID = np.iinfo(np.int64).max  # stands for a null id, after all others

RUN = "run bigint, ids binary, sizes binary, texts binary"
ASKED = "run bigint, bucket int, asked binary"


_scopes: list[list[str]] = []  # folders staged inside the open scopes


@contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the folders that are staged inside."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes[:] = [s for s in _scopes if s is not own]


def removed(spark: SparkSession, folders: list[str]) -> None:
    """Removes staged folders whose tables are read no more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = hadoop.Path(folder).getParent()  # the folder that work_path made for it alone
        path.getFileSystem(conf).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of tables that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared(spark: SparkSession, value) -> Broadcast:
    """A broadcast of a fitted object together with its class, as workers lack this package.

    Each executor and the driver keep it in a file, so it is compressed: fitted weights are mostly
    zeros."""
    return spark.sparkContext.broadcast(press(cloudpickle.dumps(value)))


def given(sent: Broadcast):
    return cloudpickle.loads(unpress(sent.value))


def press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def staged(df: DataFrame, name: str, rows_of_mb: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Rows of some MB are packed already; their row groups are kept small. What the write shuffled
    is released, as Spark removes shuffle files only when the driver collects its garbage.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    for own in _scopes:
        own.append(path)
    writer = df.write.option("compression", "zstd")
    if rows_of_mb:
        writer = (df.write.option("compression", "uncompressed")
                  .option("parquet.block.size", 16 << 20)
                  .option("parquet.page.size.row.check.min", 1)
                  .option("parquet.page.size.row.check.max", 4))
    writer.parquet(path)
    schema = df.schema
    del df, writer
    released(spark)
    return spark.read.schema(schema).parquet(path)


def bucketed(table: DataFrame, name: str) -> DataFrame:
    """Rows of some MB, written in buckets of their run: a join on the run moves the other side
    alone. The table's name is needed for the write only and is dropped; its files stay."""
    spark, path = table.sparkSession, work_path(table.sparkSession, name)
    for own in _scopes:
        own.append(path)
    called = f"punctua_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (table.write.option("compression", "uncompressed").option("parquet.block.size", 16 << 20)
     .option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 4)
     .option("path", path).bucketBy(parts, "run").saveAsTable(called, format="parquet"))
    out = spark.table(called)
    spark.sql(f"DROP TABLE {called}")
    return out


def packed(docs: DataFrame, doc_id: str, text: str, run_bytes: int = RUN_BYTES,
           in_buckets: bool = False) -> DataFrame:
    """Staged runs of ``docs``: ids, sizes in bytes and texts; a null text is empty.

    ``in_buckets`` writes them so that answers move to the runs and not runs to answers.
    """
    table = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, total = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()),
                 pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()),
                 pa.array([np.array([len(t) for t in texts], dtype=np.int64).tobytes()],
                          pa.binary()),
                 pa.array([press(b"".join(texts))], pa.binary())],
                names=["run", "ids", "sizes", "texts"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), W.as_bytes(batch.column("text"))):
                if texts and (total + len(t) > run_bytes or len(texts) == RUN_TEXTS):
                    yield row()
                    number, ids, texts, total = number + 1, [], [], 0
                ids.append(NO_ID if i is None else i)
                texts.append(t)
                total += len(t)
        if texts:
            yield row()

    rows = table.mapInArrow(run, RUN)
    return bucketed(rows, "runs") if in_buckets else staged(rows, "runs", rows_of_mb=True)


def opened(row: dict) -> tuple[np.ndarray, list[bytes]]:
    """(ids, texts) of a run."""
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    sizes = np.frombuffer(row["sizes"], dtype=np.int64)
    data, ends = unpress(row["texts"]), np.cumsum(sizes)
    return ids, [data[e - n:e] for e, n in zip(ends.tolist(), sizes.tolist())]


def id_column(ids: np.ndarray, kind) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID).cast(kind)


def buckets(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mapped(table: DataFrame, function: Callable[[dict], Iterator[pa.RecordBatch]], schema: str
           ) -> DataFrame:
    """Apply ``function`` to each row (as a dict) of a table of runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from function(batch.slice(k, 1).to_pylist()[0])

    return table.mapInArrow(run, schema)


def questions(run: int, asked: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    """A row for each (bucket, values) that a run asks about."""
    rows = list(asked)
    return pa.RecordBatch.from_arrays(
        [pa.array([run] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()),
         pa.array([v for _, v in rows], pa.binary())], names=["run", "bucket", "asked"])


def answered(asked: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """``answer`` gets what all runs ask in a bucket and returns an answer for each of them."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("run", kind="stable")
        return pd.DataFrame({"run": frame["run"], "bucket": frame["bucket"],
                             "asked": answer(frame["asked"].tolist())})

    return asked.groupBy("bucket").applyInPandas(run, ASKED)


def returned(table: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """The runs with their answers, an array of (bucket, asked) in the column ``name``."""
    own = answers.groupBy(F.col("run").alias("__run")).agg(
        F.collect_list(F.struct("bucket", "asked")).alias(name))
    return table.join(own, table["run"] == own["__run"], "left").drop("__run")


def by_bucket(answers: list[dict] | None) -> dict[int, bytes]:
    return {a["bucket"]: a["asked"] for a in answers or ()}


def summed(table: DataFrame, size: int, add: Callable[[dict, np.ndarray], None],
           cut: int = 8192) -> np.ndarray:
    """Sum of ``size`` counters over all rows; ``add(row, counters)`` counts one row.

    Each task sums its rows; slices of these sums are added per slice, one batch at a time,
    and what reaches the driver has a fixed size.
    """
    schema = "slice int, sums binary"

    def batch_of(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()),
             pa.array([press(v.tobytes()) for v in parts.values()], pa.binary())],
            names=["slice", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            for k in range(batch.num_rows):
                add(batch.slice(k, 1).to_pylist()[0], counts)
            rows += batch.num_rows
        if rows:
            yield batch_of({k: counts[c:c + cut] for k, c in enumerate(range(0, size, cut))})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(unpress(blob), dtype=np.int64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield batch_of(sums)

    counts = np.zeros(size, dtype=np.int64)
    parts = table.mapInArrow(partial, schema).repartition("slice").mapInArrow(total, schema)
    for r in parts.collect():
        counts[r["slice"] * cut:(r["slice"] + 1) * cut] += np.frombuffer(
            unpress(r["sums"]), dtype=np.int64)
    return counts


# --- Values that occur more than once -------------------------------------------------------

class Values:
    """Distinct 64-bit values of a run, by bucket; of each 32 more bits are sent.

    A bucket and 32 bits may coincide by chance: that only lets a value through a filter.
    """

    def __init__(self, values: np.ndarray, n: int):
        key = ((values % np.uint64(n)) << np.uint64(32)) | (values >> np.uint64(32))
        self.keys, self.inverse, self.counts = np.unique(
            key, return_inverse=True, return_counts=True)
        bucket = (self.keys >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        self.parts = [(int(bucket[a]), a, b)
                      for a, b in zip(cuts, np.append(cuts[1:], len(bucket)))]

    def asked(self, more: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Per bucket the values and a bit for each: whether it counts as several by itself."""
        for bucket, a, b in self.parts:
            low = (self.keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield bucket, press(np.diff(low, prepend=np.uint32(0)).tobytes()
                                + np.packbits(more[a:b]).tobytes())

    def told(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each value given to the constructor whether it occurs more than once."""
        out = np.zeros(len(self.keys), dtype=bool)
        for bucket, a, b in self.parts:
            if bucket in answers:
                out[a:b] = np.unpackbits(np.frombuffer(answers[bucket], dtype=np.uint8),
                                         count=b - a)
        return out[self.inverse]


def several(asked: list[bytes]) -> list[bytes]:
    """Answer of a bucket: which values occur in several runs, or several times in one."""
    lows, more = [], []
    for blob in map(unpress, asked):
        n = len(blob) * 8 // 33  # 4 bytes and a bit for each value
        while n * 4 + (n + 7) // 8 < len(blob):
            n += 1
        lows.append(np.cumsum(np.frombuffer(blob, dtype=np.uint32, count=n), dtype=np.uint32))
        more.append(np.unpackbits(np.frombuffer(blob, dtype=np.uint8, offset=4 * n), count=n))
    _, inverse = np.unique(np.concatenate(lows), return_inverse=True)
    total = np.bincount(inverse, weights=1 + np.concatenate(more))
    told = total[inverse] >= 2
    ends = np.cumsum([len(x) for x in lows])
    return [np.packbits(told[e - len(x):e]).tobytes() for e, x in zip(ends, lows)]


# --- How often values occur -----------------------------------------------------------------

class Counted:
    """Distinct 64-bit values of a run and their counts, by bucket; of each 32 more bits are sent.

    Values that coincide in bucket and 32 bits have one count, the same in every run.
    """

    def __init__(self, values: np.ndarray, n: int):
        self.n = np.uint64(n)
        key = np.sort(self._key(values))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        self.keys, self.counts = key[first], np.diff(np.append(first, len(key))).astype(np.uint32)
        bucket = (self.keys >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        self.parts = [(int(bucket[a]), a, b)
                      for a, b in zip(cuts, np.append(cuts[1:], len(bucket)))]

    def _key(self, values: np.ndarray) -> np.ndarray:
        return ((values % self.n) << np.uint64(32)) | (values >> np.uint64(32))

    def asked(self) -> Iterator[tuple[int, bytes]]:
        """Per bucket the values, as differences, and their counts."""
        for bucket, a, b in self.parts:
            low = (self.keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield bucket, press(_planes(np.diff(low, prepend=np.uint32(0)))
                                + _planes(self.counts[a:b]))

    def told(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each of ``keys`` the power of two of its count over all runs."""
        out = np.zeros(len(self.keys), dtype=np.uint8)
        for bucket, a, b in self.parts:
            out[a:b] = np.frombuffer(unpress(answers[bucket]), dtype=np.uint8)
        return out

    def places(self, values: np.ndarray) -> np.ndarray:
        """Where values given to the constructor are in ``keys``."""
        return np.searchsorted(self.keys, self._key(values))


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, all lowest bytes first: the others are mostly zero and compress."""
    return numbers.view(np.uint8).reshape(-1, 4).T.tobytes()


def powers(asked: list[bytes]) -> list[bytes]:
    """Answer of a bucket: per value the power of two of its count; 1 stands for a single one."""
    lows, counts = [], []
    for blob in map(unpress, asked):
        both = np.frombuffer(blob, dtype=np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)
        low, count = np.ascontiguousarray(both).view(np.uint32)[:, :, 0]
        lows.append(np.cumsum(low, dtype=np.uint32))
        counts.append(count)
    _, inverse = np.unique(np.concatenate(lows), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts))
    power = np.frexp(total)[1].astype(np.uint8)[inverse]
    ends = np.cumsum([len(x) for x in lows])
    return [press(power[e - len(x):e].tobytes()) for e, x in zip(ends, lows)]
