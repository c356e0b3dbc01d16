"""N-gram Jaccard join with set-relation skipping; components of the links.

A document's set is its distinct word shingles. Two documents link when their sets' Jaccard
similarity is at least ``percent`` / 100. Equal sets are one set with one name.

Index: every set is ordered rarest shingle first (by the power of two of its count, then by hash), and
its prefix is posted: linked sets share a shingle of their prefixes. A first exchange counts every
shingle, by the distinct sets of each run, so lists are as short as their shingles are rare however
many documents there are, and shingles with a count of one are not posted. A list is then read in
skips:

* by size and position: from the places of a pair's shared prefix shingles follows the largest
  overlap it can have; lists are cut into size classes, and only neighbouring ones meet;
* by answers: some lists, one of LISTS by hash and more of short sets, first meet a pivot, their
  most central set, and these overlaps are computed; a second pivot is taken from the sets that
  did not join the first. Then all lists are read: sets of one component need no further answer,
  for the others the overlap with the pivot bounds the overlap with each other, and pairs that
  cannot link are skipped. What is left meets pairwise;
* by sketches: a set's sketch has the parity of its shingles per bit of their hash. Two sketches
  differ in no more bits than their sets differ in shingles, so pairs whose sketches differ in more
  than linked sets may do are skipped before their sets are read.

So a list costs its length per pivot, not its square, and the pairs computed are exact. Overlaps
are counted on whole sets of 64-bit shingle hashes.

Components come from alternating star contractions, without a collect. The graph holds enough
links to connect every component, not all links of a group.

Defined cases: words are `[^\\x20\\x09-\\x0D]+`, A-Z in lower case; fewer words than a shingle
make one shingle, the whole sequence. Null texts and texts without words have an empty set,
n_shingles 0, and are their own component. Repeated rows link with each other (equal sets).
Rows with a null id link too; a component of such rows alone has a null component_id. Other
columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctua.llm import runs as R
from punctua.llm import words as W

U = np.uint64
GROUP = 256  # sets that meet a pivot in one task
LISTS = 8  # one list of so many has pivots; a power of two
LEAST_LISTS = 6  # lists with pivots that a set has by expectation, if it has so many
SENT = 1_000_000  # numbers of 8 bytes that may be broadcast
SKETCH = [f"s{k}" for k in range(8)]  # words of a sketch, 64 bits each


def sets_of(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, hashes in W.word_hashes(texts, lower=True):
        yield np.unique(W.shingles(hashes, size))


def name_of(values: np.ndarray) -> bytes:
    """128 bits that name a set."""
    first = np.bitwise_xor.reduce(W.mix(values + U(1))) if len(values) else U(0)
    second = np.add.reduce(W.mix(values ^ W.BASES[0])) if len(values) else U(0)
    return int(first).to_bytes(8, "big") + int(second).to_bytes(8, "big")


def prefix_of(rarity: np.ndarray, percent: int) -> np.ndarray:
    """Places of the rarest shingles of a sorted set, of which linked sets share one, in order."""
    n = len(rarity)
    return np.argsort(rarity, kind="stable")[:n - -(-percent * n // 100) + 1 if n else 0]


def sketch_of(values: np.ndarray) -> np.ndarray:
    """Parities of the shingles per bit, as 64-bit words."""
    bits = np.bincount((values & U(64 * len(SKETCH) - 1)).astype(np.int64),
                       minlength=64 * len(SKETCH)) & 1
    return np.packbits(bits.astype(bool)).view(np.int64)


def first_runs(asked: list[bytes]) -> list[bytes]:
    """Answer of a bucket of names: whether the run is the first that holds the set."""
    names = [np.frombuffer(b, dtype="V16", offset=1) for b in asked]
    _, first = np.unique(np.concatenate(names), return_index=True)
    own = np.zeros(sum(map(len, names)), dtype=bool)
    own[first] = True
    ends = np.cumsum([len(x) for x in names])
    return [np.packbits(own[e - len(x):e]).tobytes() for e, x in zip(ends, names)]


class Described:
    """The sets of a run: name and size of every text, values of the distinct sets."""

    def __init__(self, row: dict, size: int, n: int):
        self.ids, texts = R.opened(row)
        self.of: list[tuple[bytes, int]] = []
        self.place: dict[bytes, int] = {}
        self.values: list[np.ndarray] = []
        for k, values in enumerate(sets_of(texts, size)):
            name = name_of(values)
            self.of.append((name, len(values)))
            if len(values) and name not in self.place:
                self.place[name] = k
                self.values.append(values)
        self.names = list(self.place)
        self.counted = R.Counted(np.concatenate([np.zeros(0, dtype=np.uint64), *self.values]), n)

    def asked_names(self, n: int) -> Iterator[tuple[int, bytes]]:
        """Names by bucket n .. 2n - 1, in their order in the run."""
        for bucket, names in self._by_bucket(n).items():
            yield n + bucket, b"N" + b"".join(self.names[k] for k in names)

    def owned(self, n: int, answers: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(self.names), dtype=bool)
        for bucket, names in self._by_bucket(n).items():
            out[names] = np.unpackbits(np.frombuffer(answers[n + bucket], dtype=np.uint8),
                                       count=len(names))
        return out

    def _by_bucket(self, n: int) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for k, name in enumerate(self.names):
            found.setdefault(int.from_bytes(name[:6], "big") % n, []).append(k)
        return found


def number_of(run: int, place):
    """A set's number: task, run of the task, place in the run."""
    return ((run >> 32) << 36) + ((run & 0xFFFFFFFF) << 20) + place


def described(table: DataFrame, kind: str, size: int, percent: int
              ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, name) of rows; (name, set, sketch) of sets; postings (token, set, n, place,
    central).

    A set has one number, given by the first run that holds it; postings are the shingles of its
    prefix with a count of two or more, sets are those that have postings.
    """
    spark = table.sparkSession
    n = R.buckets(table)

    def ask(row: dict) -> Iterator[pa.RecordBatch]:
        own = Described(row, size, n)
        yield R.questions(row["run"], itertools.chain(own.counted.asked(), own.asked_names(n)))

    def answer(asked: list[bytes]) -> list[bytes]:
        return first_runs(asked) if asked[0][:1] == b"N" else R.powers(asked)

    schema = ("doc_id bigint, name binary, set bigint, token bigint, n int, place int, central int, "
              + ", ".join(f"{c} bigint" for c in SKETCH))
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(count: int, **columns) -> pa.RecordBatch:
        kinds = {"name": pa.binary(), "n": pa.int32(), "place": pa.int32(),
                 "central": pa.int32()}
        return pa.RecordBatch.from_arrays(
            [columns[c] if isinstance(columns.get(c), pa.Array)
             else pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns
             else pa.nulls(count, kinds.get(c, pa.int64())) for c in names], names=names)

    def post(row: dict) -> Iterator[pa.RecordBatch]:
        own = Described(row, size, n)
        yield batch(len(own.of), doc_id=R.id_column(own.ids, pa.int64()),
                    name=[s for s, _ in own.of], n=[k for _, k in own.of])
        answers = R.by_bucket(row["shared"])
        power = own.counted.told(answers)
        tokens, several = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=bool)]
        for values in own.values:
            rarity = power[own.counted.places(values)]
            prefix = prefix_of(rarity, percent)
            tokens.append(values[prefix])
            several.append(rarity[prefix] > 1)  # two sets or more
        sizes = np.array([len(p) for p in tokens[1:]], dtype=np.int64)
        tokens, told = np.concatenate(tokens), np.concatenate(several)
        which = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        shared = np.bincount(which, weights=told, minlength=len(sizes))
        central = (1000 * shared / np.maximum(sizes, 1)).astype(np.int32)
        wanted = own.owned(n, answers) & (shared > 0)
        numbers = number_of(row["run"], np.array([own.place[s] for s in own.names], dtype=np.int64))
        counts = np.array([len(v) for v in own.values], dtype=np.int32)
        k = np.flatnonzero(wanted)
        sketches = np.array([sketch_of(own.values[x]) for x in k.tolist()],
                            dtype=np.int64).reshape(len(k), len(SKETCH))
        yield batch(len(k), name=[own.names[x] for x in k.tolist()], set=numbers[k],
                    **dict(zip(SKETCH, np.ascontiguousarray(sketches.T))))
        k = np.flatnonzero(told & wanted[which]) if len(which) else which
        if len(k):
            yield batch(len(k), set=numbers[which[k]], token=tokens[k].view(np.int64),
                        n=counts[which[k]], place=place[k].astype(np.int32),
                        central=central[which[k]])

    with R.scope() as folders:
        shared = R.staged(R.answered(R.mapped(table, ask, R.ASKED), answer), "shared")
        rows = R.staged(R.mapped(R.returned(table, shared, "shared"), post, schema), "described")
    R.removed(spark, folders[:-1])
    docs = rows.where("token IS NULL AND set IS NULL").select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n", "name")
    sets = rows.where("token IS NULL AND set IS NOT NULL").select("name", "set", *SKETCH)
    return docs, sets, rows.where("token IS NOT NULL").select(
        "token", "set", "n", "place", "central")


def may_link(n: Column, m: Column, overlap: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (n + m - overlap)


def near(n: Column, m: Column, percent: int, words: list[str] = SKETCH) -> Column:
    """Whether the sketches allow a link: they differ in at most n + m - 2 * overlap bits."""
    differing = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + "_b"))) for c in words), F.lit(0))
    return (100 + percent) * (n + m - differing) >= 2 * percent * (n + m)


def sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n, m) whose sketches allow a link."""
    other = sketches.select(F.col("set").alias("b"), *[F.col(c).alias(c + "_b") for c in SKETCH])
    met = pairs.join(sketches.withColumnRenamed("set", "a"), "a").join(other, "b")
    return met.where(near(F.col("n"), F.col("m"), percent)).select("a", "b", "n", "m")


def bounded(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n, m) whose shared prefix shingles allow enough overlap.

    ``met`` has a row per pair and shared shingle, with its places i and j in both sets. All
    common shingles up to the last shared one are counted; after it at most the shorter rest is
    common.
    """
    pairs = met.groupBy("a", "b").agg(
        F.first("n").alias("n"), F.first("m").alias("m"), F.count("*").alias("c"),
        F.max("i").alias("i"), F.max("j").alias("j"))
    most = F.col("c") + F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("j"))
    return pairs.withColumn("most", most.cast("int")).where(
        may_link(F.col("n"), F.col("m"), F.col("most"), percent)).select("a", "b", "n", "m")


def values_of(table: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(set, values) of the sets with these numbers, read again from their runs.

    Up to ``SENT`` numbers are sent to the tasks; beyond that the runs are shuffled to them.
    """
    ids = R.staged(ids.distinct(), "wanted")
    run = F.shiftleft(F.shiftright("set", 36), 32) + F.shiftright("set", 20).bitwiseAND(0xFFFF)
    own = ids.groupBy(run.alias("__run")).agg(F.collect_list("set").alias("wanted"))
    if ids.count() <= SENT:
        own = F.broadcast(own)

    def read(row: dict) -> Iterator[pa.RecordBatch]:
        texts, mask = R.opened(row)[1], (1 << 20) - 1
        for a in range(0, len(row["wanted"]), 500):
            part = row["wanted"][a:a + 500]
            found = sets_of([texts[k & mask] for k in part], size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array([v.tobytes() for v in found], pa.binary())],
                names=["set", "values"])

    return R.mapped(table.join(own, table["run"] == own["__run"]).drop("__run"), read,
                    "set bigint, values binary")


def _common(one: bytes, other: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(one, dtype=np.uint64),
                              np.frombuffer(other, dtype=np.uint64), assume_unique=True))


OVERLAP = "a bigint, b bigint, n int, m int, overlap int"


def overlaps(table: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``pairs`` with the exact overlap; a's set meets b's in parts of bounded size."""
    with R.scope() as folders:
        found = _overlaps(table, R.staged(pairs, "pairs"), size)
    R.removed(table.sparkSession, folders[:-1])
    return found


def _overlaps(table: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    sets = R.staged(values_of(table, pairs.select(F.col("a").alias("set")).union(
        pairs.select("b")), size), "sets")
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    dealt = pairs.join(count, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    right = dealt.join(sets, F.col("b") == sets["set"]).select("a", "part", "b", "n", "m", "values")
    left = count.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(
        sets, F.col("a") == sets["set"]).select(
        F.col("a").alias("one"), F.col("part").alias("its_part"), F.col("values").alias("own"))

    def meet(one: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        shared = [_common(one["own"].iloc[0], v) for v in many["values"]]
        return many[["a", "b", "n", "m"]].assign(overlap=np.array(shared, dtype=np.int32))

    return R.staged(left.groupBy("one", "its_part").cogroup(
        right.groupBy("a", "part")).applyInPandas(meet, OVERLAP), "overlaps")


def grouped_overlaps(table: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """As ``overlaps``; sets that pairs connect travel once, to one task for the group.

    Groups of more than ``GROUP`` sets go by pairs.
    """
    with R.scope() as folders:
        pairs = R.staged(pairs, "pairs")
        found, large = _grouped(table, pairs, size)
    if large is not None:
        found = found.union(overlaps(table, large, size))
    R.removed(table.sparkSession, folders[:-1])
    return found


def _grouped(table: DataFrame, pairs: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """(overlaps of pairs in small groups, pairs in large ones if there are any)."""
    label = components(pairs)
    sizes = label.groupBy("component").agg(F.count("*").alias("sets"))
    label = R.staged(label.join(sizes, "component"), "groups")
    dealt = R.staged(pairs.join(label, F.col("a") == label["node"]).drop("node"), "dealt")
    small = label.where(F.col("sets") <= GROUP).select(F.col("node").alias("set"), "component")
    sets = values_of(table, small.select("set"), size).join(small, "set").select(
        "set", "values", F.col("component").alias("group"))

    def meet(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(own["set"], own["values"]))
        shared = [_common(known[a], known[b]) for a, b in zip(asked["a"], asked["b"])]
        return asked[["a", "b", "n", "m"]].assign(overlap=np.array(shared, dtype=np.int32))

    found = R.staged(sets.groupBy("group").cogroup(
        dealt.where(F.col("sets") <= GROUP).groupBy("component")).applyInPandas(meet, OVERLAP),
        "overlaps")
    large = dealt.where(F.col("sets") > GROUP).select("a", "b", "n", "m")
    return found, None if large.isEmpty() else large


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b): the smallest node of the component.

    Alternating large-star and small-star contractions until nothing changes; each step is
    staged, and its rows never outnumber the edges.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    with R.scope() as folders:
        edges = _contracted(R.staged(edges.distinct(), "edges"), folders)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _contracted(edges: DataFrame, folders: list[str]) -> DataFrame:
    """Edges (u, v) of each node u to its component's smallest, v; earlier steps are removed."""
    known = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        large = both.join(least.select(F.col("u").alias("w"), F.least("u", "least").alias("x")),
                          F.col("u") == F.col("w")).where("v > u").select(
            F.col("v").alias("u"), F.col("x").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("x"))
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        small = small.where("v <> x").select(F.col("v").alias("u"), F.col("x").alias("v")).union(
            least.select("u", F.col("x").alias("v")))
        edges = R.staged(small.distinct(), "edges")
        R.removed(edges.sparkSession, folders[:-1])
        del folders[:-1]
        # A sum of hashes tells whether the edges changed.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            return edges
        known = state


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4,
           percent: int = 85, pivots: int = 2, run_bytes: int = R.RUN_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    return _named(docs, doc_id, text, size, percent, pivots, run_bytes).drop("name")


def _named(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, pivots: int,
           run_bytes: int) -> DataFrame:
    """As ``linked``, with the name of every row's set."""
    table = R.packed(docs, doc_id, text, run_bytes)
    rows, sets, postings = described(table, docs.schema[doc_id].dataType.simpleString(), size,
                                     percent)
    # Any lists do for the pivots; a part of them, by hash of the shingle, finds most links.
    some = R.staged(postings.where(_has_pivot(percent)), "some")
    open_ = some.join(some.groupBy("set").agg(F.count("*").alias("lists")), "set").withColumn(
        "component", F.col("set")).withColumn("passed", F.lit(False))
    sketches = sets.select("set", *SKETCH)
    links = known = None
    for _ in range(pivots):
        pairs, pivot = _pivot_pairs(open_, percent)
        found = overlaps(table, sketched(pairs, sketches, percent), size)
        known = found if known is None else known.union(found)
        new = found.where(_is_link(percent)).select("a", "b")
        links = R.staged(new if links is None else links.union(new), "links")
        label = R.staged(components(links), "labels")
        open_ = _still_open(open_.drop("component"), pivot, label)
    with R.scope() as folders:
        pairs = R.staged(sketched(_other_pairs(postings, label, known, sketches, percent),
                                  sketches, percent), "pairs")
    R.removed(docs.sparkSession, folders[:-1])
    found = grouped_overlaps(table, pairs, size)
    links = links.union(found.where(_is_link(percent)).select("a", "b"))
    label = components(links).withColumnRenamed("node", "set")
    label = sets.select("name", "set").join(label, "set").select("name", "component")
    named = rows.where("n > 0").join(label, "name", "left").withColumn(
        "component", F.coalesce(F.col("component").cast("string"), F.hex("name")))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "component").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "name")
    alone = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"),
                                       F.col("doc_id").alias("component_id"), "name")
    return out.unionByName(alone)


def _is_link(percent: int) -> Column:
    return may_link(F.col("n"), F.col("m"), F.col("overlap"), percent)


def _has_pivot(percent: int) -> Column:
    """Whether a posting is in a list with pivots: of sets with short prefixes more lists are."""
    prefix = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    share = F.lit(1)
    for k in range(1, LISTS.bit_length()):
        share = F.when(prefix >= LEAST_LISTS << k, F.lit(1 << k)).otherwise(share)
    return F.pmod(F.col("token"), share) == 0


def _pivot_pairs(open_: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of every open list's pivot with its other sets, the pivots).

    Sets that share less than half of their lists with the pivot are left to the last step.
    """
    pivot = open_.where("NOT passed").groupBy("token").agg(F.max(F.struct(
        "central", "set", "n", "lists", "component")).alias("p"))
    met = open_.join(pivot, "token").where("set <> p.set AND component <> p.component").select(
        F.col("p.set").alias("a"), F.col("set").alias("b"), F.col("p.n").alias("n"),
        F.col("n").alias("m"), F.least("lists", "p.lists").alias("lists"))
    met = met.where(may_link(F.col("n"), F.col("m"), F.least("n", "m"), percent))
    pairs = met.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("m").alias("m"),
                                      F.first("lists").alias("lists"), F.count("*").alias("c"))
    return pairs.where("2 * c >= lists").select("a", "b", "n", "m"), pivot


def _still_open(open_: DataFrame, pivot: DataFrame, label: DataFrame) -> DataFrame:
    """Lists of several components; ``passed`` marks the components of their pivots.

    These sets have met the pivot, so the next one comes from the others.
    """
    left = open_.join(label.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "component", F.coalesce("component", "set"))
    of_pivot = pivot.select("token", F.col("p.set").alias("node")).join(label, "node", "left").select(
        "token", F.coalesce("component", "node").alias("joined"))
    several = left.groupBy("token").agg(
        F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    left = left.join(several.select("token"), "token", "left_semi").join(of_pivot, "token", "left")
    passed = F.col("passed") | F.coalesce(F.col("component") == F.col("joined"), F.lit(False))
    return R.staged(left.withColumn("passed", passed).drop("joined"), "open")


def _other_pairs(postings: DataFrame, label: DataFrame, known: DataFrame, sketches: DataFrame,
                 percent: int) -> DataFrame:
    """All pairs of different components that share a list and may link.

    The most central set of a list is what the others are compared by: their known overlaps
    with it bound the overlap with each other, as their sketches do.
    """
    half = len(SKETCH) // 2  # sketches travel folded, and meet whole where two sets are left
    folded = [F.col(c).bitwiseXOR(F.col(d)).alias(c) for c, d in zip(SKETCH[:half], SKETCH[half:])]
    left = postings.join(label.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "component", F.coalesce("component", "set"))
    several = left.groupBy("token").agg(
        F.min("component").alias("x"), F.max("component").alias("y"),
        F.max(F.struct("central", "set", "n")).alias("p")).where("x <> y").select(
        "token", F.col("p.set").alias("a"), F.col("p.n").alias("pn"))
    own = left.join(several, "token").join(
        known.groupBy("a", F.col("b").alias("set")).agg(F.max("overlap").alias("overlap")),
        ["a", "set"], "left").join(sketches.select("set", *folded), "set")
    words = SKETCH[:len(folded)]
    itself = F.col("a") == F.col("set")
    low = F.when(itself, F.col("n")).otherwise(F.coalesce("overlap", F.lit(1)))
    high = F.when(itself, F.col("n")).otherwise(F.coalesce("overlap", F.least("n", "pn")))
    # Size classes: sets that may link are in one class or in neighbouring ones, and the set of the
    # smaller class is then b.
    own = R.staged(own.select(
        "token", "set", "n", "place", "component", low.alias("low"), high.alias("high"),
        F.floor(F.log(F.col("n")) / np.log(100 / percent)).alias("class"), *words), "open")
    other = own.select(
        "token", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"),
        F.col("class").alias("class_b"),
        F.col("set").alias("b"), F.col("n").alias("m"), F.col("place").alias("j"),
        F.col("component").alias("component_b"), F.col("low").alias("low_b"),
        F.col("high").alias("high_b"), *[F.col(c).alias(c + "_b") for c in words])
    most = (F.least("high", "high_b")
            + F.least(F.col("n") - F.col("low"), F.col("m") - F.col("low_b")))
    met = own.join(other, ["token", "class"]).where(
        ((F.col("set") < F.col("b")) | (F.col("class_b") < F.col("class")))
        & (F.col("component") != F.col("component_b"))
        & may_link(F.col("n"), F.col("m"), F.least(most, F.col("n"), F.col("m")), percent)
        & near(F.col("n"), F.col("m"), percent, words)).select(
        F.col("set").alias("a"), "b", "n", "m", F.col("place").alias("i"), "j")
    return bounded(met, percent)


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4,
              percent: int = 85, pivots: int = 2, run_bytes: int = R.RUN_BYTES) -> DataFrame:
    """One id of each component: the smallest; its rows stay together.

    Rows are judged by their own text: where an id has several texts, only those go that are in
    a component with a smaller id. Rows with a null id stay.
    """
    rows = _named(docs, doc_id, text, size, percent, pivots, run_bytes).where("doc_id IS NOT NULL")
    rows = R.staged(rows.select(F.col("doc_id").alias("__id"), F.col("name").alias("__name"), (
        F.col("doc_id") != F.col("component_id")).alias("__goes")), "judged")
    ids = rows.groupBy("__id").agg(F.bool_and("__goes").alias("all"), F.bool_or("__goes").alias("any"))
    ids = R.staged(ids.where("any").select("__id", "all"), "dropped")
    gone, mixed = ids.where("all").select("__id"), ids.where("NOT all").select("__id")
    left = docs.join(gone, docs[doc_id] == gone["__id"], "left_anti")
    if mixed.isEmpty():
        return left
    columns = docs.columns
    some = left.join(mixed, left[doc_id] == mixed["__id"], "left_semi")
    others = left.join(mixed, left[doc_id] == mixed["__id"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [name_of(v) for v in sets_of(W.as_bytes(batch.column(text)), size)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.binary())], names=[*columns, "__own"])

    some = some.mapInArrow(run, T.StructType([*docs.schema.fields,
                                              T.StructField("__own", T.BinaryType())]))
    goes = rows.where("__goes").select("__id", "__name").distinct()
    some = some.join(goes, (some[doc_id] == goes["__id"]) & (some["__own"] == goes["__name"]),
                     "left_anti")
    return others.unionByName(some.select(columns))


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(trim(regexp_replace(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, len(w) AS k, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d
    WHERE w <> ['']),
s AS (SELECT DISTINCT doc_id, CASE WHEN k < 4 THEN whole ELSE four END AS g FROM (
    SELECT doc_id, k, i, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' '
        || lead(t, 3) OVER o AS four,
        string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole
    FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE k < 4 OR four IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g)
    WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
    WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, via) AS (SELECT doc_id, doc_id FROM documents
    UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.via)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.via) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
