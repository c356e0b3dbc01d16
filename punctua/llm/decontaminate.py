"""Benchmark decontamination: short test items inside long documents.

A document contains an item when it holds at least ``share`` of the item's distinct word
shingles. Items are partitioned by their number of shingles; each partition is an index of
MinHash values, the item's smallest shingle hashes. Of n shingles of which `need` must be found,
any n - need + 1 include one that a containing document holds, so a sketch of that length
finds every containing document, however long it is. Candidates are counted on whole hashed
sets and the rest verified on the words themselves.

Items are a query set: they travel to the tasks in blocks of at most ``block_bytes`` of text,
each block against all documents. Nothing of the documents is shuffled or collected.

Defined cases: words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. An item of fewer words
than a shingle is one shingle, its whole sequence. Null or empty items match nothing, null or
empty documents hold nothing. Repeated documents or items give repeated results, a null id is
returned as null. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from punctua.llm import runs as R
from punctua.llm import words as W

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def exact_shingles(text: bytes, size: int) -> set[bytes]:
    """The word shingles themselves; for a shorter text the whole sequence as one."""
    found = WORD.findall(text.lower())  # of bytes: A-Z only
    size = min(size, len(found))
    return {b" ".join(found[i:i + size]) for i in range(len(found) - size + 1)} if size else set()


@dataclass
class Partition:
    """Items of about one size: sketch values, sorted, and the items that own them."""

    size: int  # words in a shingle
    least: int  # fewest shingles that any of its items needs
    keys: np.ndarray
    owners: np.ndarray


@dataclass
class Index:
    ids: list
    texts: list[bytes]
    sets: list[np.ndarray]
    need: list[int]
    sizes: list[int]
    partitions: list[Partition]


def build_index(rows: list[tuple[object, bytes]], size: int, share: float) -> Index:
    """Index of (id, text) items, partitioned by shingle length and number of shingles."""
    ids, texts = [i for i, _ in rows], [t for _, t in rows]
    sets, need, sizes = [], [], []
    groups: dict[tuple[int, int], list[int]] = {}
    for k, h in W.word_hashes(texts, lower=True):
        own = np.unique(W.shingles(h, size))
        sets.append(own)
        need.append(math.ceil(share * len(own) - 1e-9))
        sizes.append(min(size, len(h)))
        if len(own):
            groups.setdefault((sizes[k], len(own).bit_length()), []).append(k)
    partitions = []
    for (words, _), members in sorted(groups.items()):
        keys = np.concatenate([sets[k][:len(sets[k]) - need[k] + 1] for k in members])
        owners = np.concatenate([np.full(len(sets[k]) - need[k] + 1, k) for k in members])
        order = np.argsort(keys, kind="stable")
        partitions.append(Partition(words, min(need[k] for k in members), keys[order],
                                    owners[order]))
    return Index(ids, texts, sets, need, sizes, partitions)


def search(index: Index, hashes: np.ndarray, text: bytes) -> list[tuple[int, int]]:
    """(item, shingles found) of every item that the document contains."""
    sets: dict[int, np.ndarray] = {}
    candidates: set[int] = set()
    for part in index.partitions:
        if len(hashes) < part.size:
            continue
        own = sets.get(part.size)
        if own is None:
            own = sets[part.size] = W.shingles(hashes, part.size)
        if len(own) < part.least:
            continue
        left = np.searchsorted(part.keys, own, "left")
        hit = part.keys[np.minimum(left, len(part.keys) - 1)] == own
        for key in np.unique(own[hit]):
            a, b = np.searchsorted(part.keys, key, "left"), np.searchsorted(part.keys, key, "right")
            candidates.update(part.owners[a:b].tolist())
    found, exact = [], {}
    for k in sorted(candidates):
        size = index.sizes[k]
        if np.isin(index.sets[k], sets[size]).sum() < index.need[k]:
            continue
        if size not in exact:
            exact[size] = exact_shingles(text, size)
        shared = len(exact_shingles(index.texts[k], size) & exact[size])
        if shared >= index.need[k]:
            found.append((k, shared))
    return found


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> list[list]:
    """Items in blocks of about ``block_bytes`` of text, dealt by hash."""
    table = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(
        F.length(text) > 0)
    total = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    if n == 1:
        return [[(r[0], r[1].encode()) for r in table.collect()]]
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return [[(r[0], r[1].encode()) for r in table.where(part == k).collect()] for k in range(n)]


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
              item_id: str = "item_id", item_text: str = "text", size: int = 5,
              share: float = 0.8, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every contained item."""
    kinds = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    rows_of = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = (f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, "
              "n_shared bigint, n_item bigint, containment double")
    id_kind = to_arrow_type(kinds[1])
    out = None
    for rows in item_blocks(items, item_id, item_text, block_bytes):
        index = R.shared(docs.sparkSession, build_index(rows, size, share))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = R.given(index)
            for batch in batches:
                texts = W.as_bytes(batch.column("text"))
                rows, items, shared, sizes = [], [], [], []
                for k, hashes in W.word_hashes(texts, lower=True):
                    for item, count in search(known, hashes, texts[k]):
                        rows.append(k)
                        items.append(known.ids[item])
                        shared.append(count)
                        sizes.append(len(known.sets[item]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(rows)), pa.array(items, id_kind),
                         pa.array(shared, pa.int64()), pa.array(sizes, pa.int64()),
                         pa.array(np.array(shared) / np.array(sizes), pa.float64())],
                        names=["doc_id", "item_id", "n_shared", "n_item", "containment"])

        found = rows_of.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
          item_text: str = "text", size: int = 5, share: float = 0.8,
          block_bytes: int = 32 << 20) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    for rows in item_blocks(items, item_id, item_text, block_bytes):
        index = R.shared(docs.sparkSession, build_index(rows, size, share))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = R.given(index)
            for batch in batches:
                texts = W.as_bytes(batch.column(text))
                keep = [not search(known, hashes, texts[k])
                        for k, hashes in W.word_hashes(texts, lower=True)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                     spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS r, string_split(trim(regexp_replace(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
bw AS (SELECT r, item_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM b),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, x || ' ' || lead(x, 1) OVER o || ' '
    || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS s FROM dw
    WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE s IS NOT NULL),
bs AS (SELECT DISTINCT r, item_id, s FROM (SELECT r, item_id, x || ' ' || lead(x, 1) OVER o || ' '
    || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS s FROM bw
    WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE s IS NOT NULL),
n AS (SELECT r, count(*) AS n_item FROM bs GROUP BY r),
c AS (SELECT doc_id, r, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s)
    GROUP BY doc_id, r, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM c JOIN n USING (r) WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
"""
