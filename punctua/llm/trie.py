"""Conversation prefix trie by collapse of whole sequences.

Identical conversations are grouped into one weighted sequence with the list of those that end
there. A sequence that is a proper prefix of another one is dropped by an anti-join, which leaves
the leaves. Each distinct sequence then gives its prefixes once, with its weight, and aggregates
over equal prefixes are the nodes. A node is named by its depth and the exclusive or of 128-bit
hashes of its (position, turn) pairs; texts are read once and never shuffled.

Sums over subtrees need no walk: every node belongs to the least sequence through it, a sequence
owns an unbroken end of its own path, and so the bytes of the nodes below a node are a sum over
the sequences through it.

Long conversations are split: turns are numbered by a range sort with an offset per range, and
running hashes and sums are made in blocks of ``BLOCK`` turns. Hot sequences, first turns and end
lists are handled by ``lookups.lookup``, partial aggregation, and packed id lists that are hashed
as a stream.

Defined cases: a null role or text is empty. Turns are ordered by number, null first; of equal
numbers by the MD5 of role and text, so that repeated rows are turns of their own, side by side.
Rows with a null conv_id take no part. A conversation that is left without turns is a member of
the root and ends there. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctua.llm import runs as R
from punctua.llm.lookups import lookup

BLOCK = 4096  # turns whose running hash one window makes
IDS = 8192  # ids in a packed piece of an end list
NODE = ["depth", "k1", "k2"]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
             role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, size): the turns of each conversation numbered from 0.

    ``digest`` names role and text, ``size`` is the text's length in bytes.
    """
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)).alias("digest"),
        F.octet_length(said).cast("long").alias("size"), F.rand(7).alias("spread"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("spread")]
    placed = R.staged(
        rows.repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order).select(
            "conv", "digest", "size", F.monotonically_increasing_id().alias("place")), "placed")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("conv", "part").agg(
        F.min("place").alias("start"), F.count("*").alias("n"))
    ranges = ranges.select("conv", "part", (
        F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("start")).alias("shift"))
    return placed.join(ranges, ["conv", "part"]).select(
        "conv", (F.col("place") + F.col("shift")).alias("pos"), "digest", "size")


def rebuilt(turns: DataFrame, base: Column, share: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one.

    Conversation ``conv`` gets the first ``share`` turns of conversation ``base`` (both columns of
    ``conv``; ``share`` is at most ``most``) and its own turns after its first ``share``. Returns
    the turns (conv, depth from 1, digest, size, length) and the conversations (conv, length).
    ``turns`` is read several times. ``base`` is the same for at most a few conversations.
    """
    counts = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = counts.select("conv", "n", base.alias("base"), share.cast("long").alias("share"))
    convs = convs.join(counts.select(F.col("conv").alias("base"), F.col("n").alias("n_base")),
                       "base", "left")
    given = F.least("share", F.coalesce("n_base", F.lit(0)))
    convs = R.staged(convs.select(
        "conv", "base", "share", given.alias("given"),
        (given + F.greatest(F.col("n") - F.col("share"), F.lit(0))).alias("length")), "convs")
    first = turns.where(F.col("pos") < most).select(
        F.col("conv").alias("base"), "pos", "digest", "size")
    begin = convs.where("share > 0").join(first, "base").where("pos < share").select(
        "conv", (F.col("pos") + 1).alias("depth"), "digest", "size", "length")
    own = lookup(turns, convs, ["conv"]).where("pos >= share").select(
        "conv", (F.col("given") + F.col("pos") - F.col("share") + 1).alias("depth"), "digest",
        "size", "length")
    return own.unionByName(begin), convs.select("conv", "length")


def running(turns: DataFrame) -> DataFrame:
    """(conv, depth, e1, e2, k1, k2, before, size, length) of rebuilt turns.

    e1, e2 hash the turn at its depth; k1, k2 the sequence up to it; ``before`` are the bytes of
    the turns before it.
    """
    block = F.expr(f"depth div {BLOCK}")
    rows = turns.select("conv", "depth", F.xxhash64("depth", "digest").alias("e1"),
                        F.xxhash64("digest", "depth").alias("e2"), "size", "length",
                        block.alias("block"))
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(
        Window.unboundedPreceding, 0)
    done = rows.select("*", F.bit_xor("e1").over(inside).alias("k1"),
                       F.bit_xor("e2").over(inside).alias("k2"),
                       F.sum("size").over(inside).alias("upto"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.where(F.col("length") >= BLOCK).groupBy("conv", "block").agg(
        F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"), F.sum("size").alias("sized"))
    carry = carry.select("conv", "block", *[F.coalesce(f.over(earlier), F.lit(0)).alias(n) for n, f in (
        ("c1", F.bit_xor("x1")), ("c2", F.bit_xor("x2")), ("c", F.sum("sized")))])
    zero = F.lit(0)
    return done.join(carry, ["conv", "block"], "left").select(
        "conv", "depth", "e1", "e2",
        F.col("k1").bitwiseXOR(F.coalesce("c1", zero)).alias("k1"),
        F.col("k2").bitwiseXOR(F.coalesce("c2", zero)).alias("k2"),
        (F.col("upto") - F.col("size") + F.coalesce("c", zero)).alias("before"), "size", "length")


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of (depth, k1, k2, conv).

    Ids are sorted by range and packed; the pieces of a node, some KB each, then pass through one
    SHA-256 as a stream.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in NODE], axis=1)
            ids = batch.column("conv").to_numpy()
            cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(ids) else []
            starts = [s for a, b in zip(cut, [*cut[1:], len(ids)]) for s in range(a, b, IDS)]
            stops = [*starts[1:], len(ids)]
            out = [pa.array(keys[starts, k], pa.int64()) for k in range(3)] if starts else [
                pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array([int(ids[a]) for a in starts], pa.int64()),
                 pa.array([ids[a:b].astype("<i8").tobytes() for a, b in zip(starts, stops)],
                          pa.binary())], names=[*NODE, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key, state):
            return pa.RecordBatch.from_arrays(
                [*[pa.array([v], pa.int64()) for v in key], pa.array([state.hexdigest()])],
                names=[*NODE, "ends_sha256"])

        key, state = None, None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (*NODE, "ids")]
            for *own, ids in zip(*columns):
                if own != key:
                    if key is not None:
                        yield row(key, state)
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, np.frombuffer(ids, "<i8").tolist())).encode())
        if key is not None:
            yield row(key, state)

    n = _parts(ends)
    packed = ends.repartitionByRange(n, *NODE, "conv").sortWithinPartitions(*NODE, "conv").select(
        *NODE, "conv").mapInArrow(pieces, "depth long, k1 long, k2 long, first long, ids binary")
    return packed.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the prefix trie, the textless root included.

    ``turns``: (conv, depth, digest, size, length); ``convs``: (conv, length). A node's turn is the
    one at ``depth`` in conversation ``conv_id``. Returns conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.
    """
    steps = R.staged(running(turns), "steps")
    none = [F.lit(0).cast("long").alias(c) for c in (*NODE, "total")]
    ends = steps.where("depth = length").select(
        "conv", *NODE, (F.col("before") + F.col("size")).alias("total")).unionByName(
        convs.where("length = 0").select("conv", *none))
    # Identical conversations are one sequence, named by the least of them.
    sequences = R.staged(ends.groupBy(NODE).agg(
        F.min("conv").alias("seq"), F.count("*").alias("weight"), F.max("total").alias("total")),
        "sequences")
    names = sequences.select(F.col("seq").alias("conv"))
    root = sequences.select(
        F.col("seq"), *[F.lit(0).cast("long").alias(c) for c in (
            "depth", "e1", "e2", "k1", "k2", "before")], F.col("depth").alias("length"))
    prefixes = R.staged(lookup(steps, names, ["conv"]).select(
        F.col("conv").alias("seq"), "depth", "e1", "e2", "k1", "k2", "before", "length"
    ).unionByName(root), "prefixes")
    # Proper prefixes of others go; the leaves stay.
    proper = prefixes.where("depth < length").select(NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("seq", F.lit(1).alias("leaf"))
    # A node belongs to its least sequence; a sequence owns the end of its path from ``head`` on.
    owners = R.staged(prefixes.groupBy(NODE).agg(
        F.min("seq").alias("owner"), F.min("before").alias("before"), F.min("e1").alias("e1"),
        F.min("e2").alias("e2")), "owners")
    heads = R.staged(owners.groupBy(F.col("owner").alias("seq")).agg(F.min(F.struct(
        "depth", "before", F.col("k1").bitwiseXOR(F.col("e1")).alias("k1"),
        F.col("k2").bitwiseXOR(F.col("e2")).alias("k2"))).alias("h")).select(
        "seq", F.col("h.depth").alias("head"), F.col("h.before").alias("skipped"),
        (F.col("h.depth") - 1).alias("depth"), "h.k1", "h.k2"), "heads")
    parents = lookup(heads, owners.select(*NODE, F.col("owner").alias("parent")), NODE, "left")
    known = sequences.select("seq", "weight", "total", F.col("depth").alias("length")).join(
        leaves, "seq", "left").join(parents.select("seq", "head", "skipped", "parent"), "seq", "left")
    # A prefix of a sequence with a smaller id owns no node.
    known = R.staged(known.select(
        "seq", "weight", "total", "length", F.coalesce("head", F.lit(-1)).alias("head"), "parent",
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.coalesce(F.col("total") - F.col("skipped"), F.lit(0)).alias("own")), "known")
    through = lookup(prefixes.drop("length", "e1", "e2"), known, ["seq"])
    nodes = through.groupBy(NODE).agg(
        F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * F.col("total")).alias("sent"),
        F.sum("own").alias("owned"), F.sum("leaf").alias("n_leaves"),
        F.sum((F.col("head") == F.col("depth") + 1).cast("long")).alias("branches"),
        F.min("before").alias("before"),
        F.min(F.struct("seq", "length", "own", "total", "head", "parent")).alias("least"))
    # Bytes of all members from this node on, less those of the distinct nodes of the subtree.
    distinct = F.col("owned") - F.col("least.own") + F.col("least.total") - F.col("before")
    saved = F.col("sent") - F.col("n_convs") * F.col("before") - distinct
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(end_hashes(ends), NODE, "left").select(
        F.col("least.seq").alias("conv_id"), "depth",
        F.when(F.col("depth") == 0, F.lit(None).cast("long")).when(
            F.col("least.head") < F.col("depth"), F.col("least.seq")).otherwise(
            F.col("least.parent")).alias("parent_conv_id"),
        "n_convs",
        (F.col("branches") + (F.col("least.length") > F.col("depth")).cast("long")).alias("n_children"),
        "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def prefix_nodes(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text", group: int = 5, shares: int = 9
                 ) -> DataFrame:
    """The trie of conversations rebuilt upon the first of each ``group`` of ids."""
    turns = R.staged(turns_of(conversations, conv_id, turn, role, text), "turns")
    conv = F.col("conv")
    share = F.crc32(conv.cast("string").cast("binary")) % shares
    return trie(*rebuilt(turns, conv - conv % group, share, shares - 1))


def op11_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(
           strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(
           [4294967295::BIGINT] || list_transform(
             string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
           lambda a, b: list_reduce([xor(a, b)] || range(8),
             lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS share
  FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.said
  FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.share
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.said
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.share),
steps AS (
  SELECT conv_id, said, row_number() OVER w AS depth,
         list(struct_pack(a := role, b := said)) OVER w AS path
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
reached AS (
  SELECT conv_id, depth, md5(path::VARCHAR) AS node, strlen(said) AS size FROM steps
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM convs),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size
  FROM reached GROUP BY node, depth),
edges AS (
  SELECT DISTINCT a.node AS child, b.node AS parent
  FROM reached a JOIN reached b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1),
below AS (
  SELECT DISTINCT a.node AS top, b.node
  FROM reached a JOIN reached b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
childless AS (SELECT node FROM nodes WHERE node NOT IN (SELECT parent FROM edges)),
sums AS (
  SELECT b.top, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens,
         count(l.node) AS n_leaves
  FROM below b JOIN nodes n USING (node) LEFT JOIN childless l USING (node) GROUP BY b.top),
ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM reached GROUP BY conv_id) GROUP BY node),
children AS (SELECT parent, count(*) AS n FROM edges GROUP BY parent)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
       coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN edges x ON x.child = n.node LEFT JOIN nodes p ON p.node = x.parent
LEFT JOIN children c ON c.parent = n.node JOIN sums s ON s.top = n.node
LEFT JOIN ends e ON e.node = n.node
"""
