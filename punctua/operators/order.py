"""Order statistics, ranks and running sums without an unpartitioned window.

A rank over a whole table, or inside a hot group, must not send all its rows to one task. A k-th
row is found by narrowing: a mergeable quantile sketch gives edges around it, one pass counts the
rows between the edges, and so on inside the part that holds the row, until a part has at most
``SLICE`` rows and is sorted. All groups and all k of a call are narrowed together, the edges and
counts being small arrays in the driver: a table whose groups are that small takes two jobs, a
larger one two more for every factor of 250. Counts are exact, so results are exact whatever the
sketch error or the ties. Quotas, one row for each group and k, must fit the driver.

Nulls: a null group key is a group of its own. A null value ranks as the lowest value there is
(minus infinity for fractions), below all others but equal to these; quantiles leave nulls out.
A quota below 0 counts as 0, one above the group's rows as all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, floor, log2, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from punctua.functions.columns import HASH_BITS, seeded_hash
from punctua.session import collected, settle, small_table, stage

GRID = 1000
ACCURACY = 10_000
SLICE = 200_000  # rows of one part that a task sorts
BUCKETS = 1024  # points of the sketch that also tells the number of rows


def bucket_count(rows: int) -> int:
    """A power of two: about a million rows per bucket, 256 buckets at least."""
    return 1 << max(8, ceil(log2(max(rows, 1) / 1_000_000)))


def joined(df: DataFrame, other: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on ``by`` with null keys equal to each other; ``other`` adds its further columns."""
    named = other.withColumnsRenamed({c: f"_on_{c}" for c in by})
    on = [df[c].eqNullSafe(named[f"_on_{c}"]) for c in by]
    return df.join(named, on, how).drop(*[f"_on_{c}" for c in by])


def filled(df: DataFrame, value: str, out: str) -> DataFrame:
    """``value`` as ``out`` with nulls as the lowest value of its type."""
    kind = df.schema[value].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return df.withColumn(out, F.coalesce(F.col(value).cast("double"), F.lit(float("-inf"))))
    return df.withColumn(out, F.coalesce(F.col(value).cast("bigint"), F.lit(-(2**63))))


def _constant(value, dtype: T.DataType) -> Column:
    """A literal; arrays are written as one SQL text, which is much faster to build."""
    if isinstance(value, list):
        return F.expr("array(" + ", ".join(f"'{v!r}'" for v in value) + ")").cast(dtype)
    return F.lit(value).cast(dtype)


def _grid(points: list[float]) -> str:
    return "array(" + ", ".join(f"{p!r}D" for p in points) + ")"


def attach(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Add the columns of a settled per-group table; without groups, of its one row.

    Inner semantics with groups. Without groups an empty table gives nulls.
    """
    if by:
        return joined(df, small, by)
    row = small.first()
    return df.select("*", *[_constant(row[f.name] if row else None, f.dataType).alias(f.name)
                            for f in small.schema.fields])


def locate(df: DataFrame, bounds: str, value: str, out: str, size: int) -> DataFrame:
    """Number of sorted ``bounds`` below ``value``: a binary search of about log2(size) steps.

    Each step is one generated comparison; a lambda over the array costs far more per row.
    """
    df = df.withColumn(out, F.lit(0))
    for power in reversed(range(max(1, ceil(log2(size + 1))))):
        step = 1 << power
        probe = F.get(F.col(bounds), F.col(out) + F.lit(step - 1))
        df = df.withColumn(out, F.col(out) + F.when(probe < F.col(value), step).otherwise(0))
    return df


@dataclass
class _Part:
    """Rows of one group: all, those between two values, or those of one value, maybe between two
    ids. ``asks`` are the (k, place within the part) that it holds."""

    group: tuple
    asks: list[tuple[int, int]]
    size: int | None = None
    tie: object = None
    low: object = None
    high: object = None
    id_low: int | None = None
    id_high: int | None = None
    edges: list = field(default_factory=list)

    def parts(self, zones: dict[int, int]) -> list[_Part]:
        """The zones between ``edges`` that hold an ask; ``zones`` has the rows of each."""
        out, before = [], 0
        for z in sorted(zones):
            rows = zones[z]
            asks = [(k, at - before) for k, at in self.asks if before < at <= before + rows]
            before += rows
            if not asks:
                continue
            j = z // 2
            below = self.edges[j - 1] if j else None
            above = self.edges[j] if j < len(self.edges) else None
            if self.tie is not None:
                out.append(_Part(self.group, asks, rows, self.tie, id_low=self.id_low if below is None
                                 else below, id_high=self.id_high if above is None else above))
            elif z % 2:
                out.append(_Part(self.group, asks, rows, above))
            else:
                out.append(_Part(self.group, asks, rows, low=self.low if below is None else below,
                                 high=self.high if above is None else above))
        return out


def _in_parts(rows: DataFrame, parts: list[_Part], by: list[str]) -> DataFrame:
    """(_i, _e, _want, _v, _id): the rows (by..., _v, _id) inside a part, with its number, its
    edges and the places asked for."""
    spark, kind = rows.sparkSession, rows.schema["_v"].dataType
    own = T.StructType([
        T.StructField("i", T.IntegerType()), T.StructField("tie", kind), T.StructField("low", kind),
        T.StructField("high", kind), T.StructField("id_low", T.LongType()),
        T.StructField("id_high", T.LongType()),
        T.StructField("e", T.ArrayType(T.LongType() if parts and parts[0].tie is not None else kind)),
        T.StructField("want", T.ArrayType(T.LongType()))])
    groups: dict[tuple, list] = {}
    for i, p in enumerate(parts):
        groups.setdefault(p.group, []).append(dict(
            i=i, tie=p.tie, low=p.low, high=p.high, id_low=p.id_low, id_high=p.id_high, e=p.edges,
            want=[at for _, at in p.asks]))
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("_one", T.IntegerType()),
                           T.StructField("_parts", T.ArrayType(own))])
    table = small_table(spark, [(*g, 0, own) for g, own in groups.items()], schema)
    if by:
        tagged = joined(rows, table.drop("_one"), by)
    else:
        tagged = rows.withColumn("_one", F.lit(0)).join(F.broadcast(table), "_one")  # one row

    def holds(p):
        value = (p["low"].isNull() | (F.col("_v") > p["low"])) & (
            p["high"].isNull() | (F.col("_v") < p["high"]))
        tied = (F.col("_v") == p["tie"]) & (p["id_low"].isNull() | (F.col("_id") > p["id_low"])) & (
            p["id_high"].isNull() | (F.col("_id") <= p["id_high"]))
        return F.coalesce(F.when(p["tie"].isNull(), value).otherwise(tied), F.lit(False))

    if len(parts) == len(groups) and all(
            p.tie is p.low is p.high is None for p in parts):  # whole groups
        found = tagged.withColumn("_p", F.get("_parts", F.lit(0)))
    else:
        found = tagged.withColumn("_p", F.explode(F.filter("_parts", holds)))
    return found.select("_v", "_id", F.col("_p.i").alias("_i"), F.col("_p.e").alias("_e"),
                        F.col("_p.want").alias("_want"))


def _sketched(rows: DataFrame, parts: list[_Part], by: list[str], clamp: bool) -> None:
    """Sets the size of every part, and edges around its asks if it is to be narrowed."""
    found = {r["_i"]: r for r in _in_parts(rows, parts, by).groupBy("_i").agg(
        *_sketch("_id" if parts[0].tie is not None else "_v")).collect()}
    for i, p in enumerate(parts):
        row = found.get(i)
        p.size = row["n"] if row else 0
        if clamp:
            p.asks = [(k, min(k, p.size)) for k, _ in p.asks]
        _edged(p, row["b"] if row else [])


def _sketch(value: str) -> list[Column]:
    """Aggregates of a part: its rows and the quantiles of ``value``."""
    grid = _grid([i / GRID for i in range(GRID + 1)])
    return [F.count(F.lit(1)).alias("n"),
            F.expr(f"percentile_approx({value}, {grid}, {ACCURACY})").alias("b")]


def _edged(part: _Part, quantiles: list) -> None:
    """Edges around the asks of a part, which drops those that it does not hold."""
    part.asks = [(k, at) for k, at in part.asks if 1 <= at <= part.size]
    points = set()
    for _, at in part.asks:
        near = at * GRID // part.size
        points |= {quantiles[max(near - 2, 0)], quantiles[min(near + 2, GRID)]}
    part.edges = sorted(points)


def _counted(rows: DataFrame, parts: list[_Part], by: list[str]) -> list[_Part]:
    """The parts between the edges of ``parts`` that hold an ask, by one counting pass."""
    ties = parts[0].tie is not None
    inside = _in_parts(rows, parts, by)
    zoned = locate(inside, "_e", "_id" if ties else "_v", "_z", max(len(p.edges) for p in parts))
    # Even zones are open intervals, odd zones hold the rows of one edge value; between ids a zone
    # holds its upper edge.
    on_edge = F.lit(0) if ties else F.coalesce(
        F.get("_e", F.col("_z")) == F.col("_v"), F.lit(False)).cast("int")
    zones: dict[int, dict[int, int]] = {}
    for r in zoned.groupBy("_i", (F.col("_z") * 2 + on_edge).alias("z")).count().collect():
        zones.setdefault(r["_i"], {})[r["z"]] = r["count"]
    return [child for i, p in enumerate(parts) for child in p.parts(zones.get(i, {}))]


def _search(rows: DataFrame, asks: list[tuple[tuple, int]], by: list[str], clamp: bool,
            with_id: bool) -> list[tuple]:
    """(group, k, value, id) of the k-th row of each group in order of (_v, _id).

    ``rows`` has (by..., _v, _id). Without ids the value alone is asked for, and a part of equal
    values is never sorted.
    """
    groups: dict[tuple, set] = {}
    for group, k in asks:
        groups.setdefault(group, set()).add(k)
    parts = [_Part(g, [(k, k) for k in sorted(ks)]) for g, ks in groups.items()]
    if parts:
        _sketched(rows, parts, by, clamp)
    return _narrowed(rows, parts, by, with_id)


def _narrowed(rows: DataFrame, waiting: list[_Part], by: list[str], with_id: bool) -> list[tuple]:
    """The search from parts that have their sizes and edges."""
    small, out, fresh = [], [], False
    while waiting:
        for ties in (False, True):  # the two kinds of edges have types of their own
            own = [p for p in waiting if (p.tie is not None) == ties]
            if not own:
                continue
            if fresh:
                _sketched(rows, own, by, False)
            waiting = [p for p in waiting if p not in own]
            own = [p for p in own if p.asks]
            small += [p for p in own if p.size <= SLICE]
            own = [p for p in own if p.size > SLICE]
            for child in _counted(rows, own, by) if own else []:
                if child.tie is not None and not with_id:
                    out += [(child.group, k, child.tie, None) for k, _ in child.asks]
                elif child.size <= SLICE or any(
                        child.size == p.size and child.tie == p.tie for p in own):
                    small.append(child)  # the latter: equal rows, which nothing can divide
                else:
                    waiting.append(child)
        fresh = True
    for part in small:
        part.edges = []
    for ties in (False, True):
        own = [p for p in small if (p.tie is not None) == ties]
        if own:
            place = F.row_number().over(W.partitionBy("_i").orderBy("_v", "_id"))
            hits = _in_parts(rows, own, by).withColumn("_r", place).where(
                F.array_contains("_want", F.col("_r").cast("bigint")))
            found = {(r["_i"], r["_r"]): r for r in hits.select("_i", "_r", "_v", "_id").collect()}
            out += [(p.group, k, found[i, at]["_v"], found[i, at]["_id"])
                    for i, p in enumerate(own) for k, at in p.asks]
    return out


def _asked(quotas: DataFrame, by: list[str]) -> list[tuple[tuple, int]]:
    rows = quotas.select(*by, F.col("k").cast("bigint").alias("k")).collect()
    return list({(tuple(r[c] for c in by), r["k"]) for r in rows if r["k"] is not None})


def _found(df: DataFrame, by: list[str], kind: T.DataType, rows: list[tuple], ids: bool) -> DataFrame:
    fields = [*[df.schema[c] for c in by], T.StructField("k", T.LongType()),
              T.StructField("cut_value", kind), *([T.StructField("cut_id", T.LongType())] if ids else [])]
    return small_table(df.sparkSession, [(*g, k, v, *([i] if ids else [])) for g, k, v, i in rows],
                       T.StructType(fields))


def kth_values(df: DataFrame, value: str, quotas: DataFrame, by: list[str] | None = None
               ) -> DataFrame:
    """The k-th smallest value per group, for every k asked for: (by..., k, cut_value).

    ``quotas`` is small with columns (by..., k). Null values are left out. A k below 1 or above
    the group's rows gives no row.
    """
    by = list(by or [])
    rows = df.select(*by, F.col(value).alias("_v"), F.lit(0).cast("bigint").alias("_id")).where(
        F.col("_v").isNotNull())
    hits = _search(rows, _asked(quotas, by), by, clamp=False, with_id=False)
    return _found(df, by, rows.schema["_v"].dataType, hits, ids=False)


def cut_points(df: DataFrame, value: str, id_col: str, quotas: DataFrame,
               by: list[str] | None = None) -> DataFrame:
    """The k-th row per group in ascending (value, id) order: (by..., k, cut_value, cut_id).

    Ids are unique and not null; null values come first, ``cut_value`` has them filled. A k
    above the group's rows is all of them, one below 1 gives no cut.
    """
    by = list(by or [])
    rows = filled(df, value, "_v").select(*by, "_v", F.col(id_col).cast("bigint").alias("_id"))
    hits = _search(rows, _asked(quotas, by), by, clamp=True, with_id=True)
    return _found(df, by, rows.schema["_v"].dataType, hits, ids=True)


def up_to(value: str, id_col: str, cut_value: str = "cut_value", cut_id: str = "cut_id"):
    """Whether a row is at or before the cut; false where there is no cut."""
    return F.coalesce(
        (F.col(value) < F.col(cut_value))
        | ((F.col(value) == F.col(cut_value)) & (F.col(id_col) <= F.col(cut_id))),
        F.lit(False),
    )


def with_cuts(df: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Left-attach one cut per group; groups without a cut get nulls."""
    if by:
        return joined(df, cuts, by, "left")
    row = cuts.first()
    fields = cuts.schema.fields
    return df.select("*", *[F.lit(row[f.name] if row else None).cast(f.dataType).alias(f.name)
                            for f in fields])


def top_k(df: DataFrame, score: str, id_col: str, quotas: DataFrame,
          by: list[str] | None = None, ascending: bool = False, out: str = "selected"):
    """Mark exactly k rows per group by score.

    ``quotas`` has (by..., n, k), n the group's rows. Ascending order breaks ties by the lowest
    id; descending order is that order reversed, so it takes the highest id first. A group
    without a quota row selects nothing; k is taken as 0 to n.
    """
    by = list(by or [])
    quotas = settle(quotas)
    k = F.greatest(F.col("k").cast("bigint"), F.lit(0))
    asked = k if ascending else F.greatest(F.col("n") - k, F.lit(0))
    cuts = cut_points(df, score, id_col, quotas.select(*by, asked.alias("k")), by)
    # One cut per group: several quotas of a group are separate calls.
    marked = with_cuts(filled(df, score, "_filled"), cuts.drop("k"), by)
    before = up_to("_filled", id_col)
    if ascending:
        chosen = before
    else:
        marked = with_cuts(marked, quotas.select(*by, F.lit(True).alias("_asked")), by)
        chosen = ~before & F.coalesce("_asked", F.lit(False))
    return marked.withColumn(out, chosen).drop("cut_value", "cut_id", "_asked", "_filled")


def first_by_hash(df: DataFrame, id_col: str, seed: str, quotas: DataFrame,
                  by: list[str] | None = None, out: str = "drawn") -> DataFrame:
    """Mark exactly k rows per group, drawn without replacement in seeded hash order.

    ``quotas`` is small with (by..., k); k is taken as 0 to the group's rows.
    """
    by = list(by or [])
    hashed = df.withColumn("_h", seeded_hash(seed, id_col))
    cuts = hash_cuts(df, id_col, seed, quotas, by).drop("k")
    marked = with_cuts(hashed, cuts, by)
    return marked.withColumn(out, up_to("_h", id_col)).drop("_h", "cut_value", "cut_id")


def hash_cuts(df: DataFrame, id_col: str, seed: str, quotas: DataFrame,
              by: list[str] | None = None) -> DataFrame:
    """The k-th row per group in (seeded hash, id) order: (by..., k, cut_value, cut_id).

    The hash is uniform, so the k-th of n rows lies close to k / n of its range: one job counts the
    rows below a narrow bracket and sorts those inside. A bracket that misses, as with many equal
    ids, is replaced by the search of ``cut_points``. ``quotas`` may have the group's rows as ``n``;
    else one more job counts them.
    """
    by = list(by or [])
    asks = _asked(quotas, by)
    if "n" in quotas.columns:
        sizes = {tuple(r[c] for c in by): r["n"] for r in quotas.select(*by, "n").collect()}
    else:
        sizes = {tuple(r[c] for c in by): r["count"] for r in df.groupBy(*by).count().collect()} \
            if by else {(): df.count()}
    rows = df.select(*by, seeded_hash(seed, id_col).alias("_v"),
                     F.col(id_col).cast("bigint").alias("_id"))
    top, parts = float(1 << HASH_BITS), []
    for group, k in sorted(asks, key=repr):
        n = sizes.get(group, 0)
        at = min(k, n)
        if at < 1:
            continue
        slack = 8.0 * sqrt(n) + 64.0
        low, high = (at - slack) / n * top, (at + slack) / n * top
        parts.append(_Part(group, [(k, at)], n, low=int(low) - 1 if low > 0 else None,
                           high=int(high) + 1 if high < top else None))
    if not parts:
        return _found(df, by, T.LongType(), [], ids=True)
    # A part here is everything below its bracket's end; rows below the bracket are counted only.
    begins = [p.low for p in parts]
    below = [_Part(p.group, p.asks, p.size, high=p.high) for p in parts]
    starts = F.array(*[F.lit(b).cast("bigint") for b in begins])
    inside = _in_parts(rows, below, by).withColumn("_b", F.get(starts, F.col("_i")))
    near = F.col("_b").isNull() | (F.col("_v") > F.col("_b"))
    place = F.element_at("_want", 1) - F.col("n")
    found = {r["_i"]: r["hit"] for r in inside.groupBy("_i", "_want").agg(
        F.count_if(~near).alias("n"),
        F.sort_array(F.collect_list(F.when(near, F.struct("_v", "_id")))).alias("s")).select(
        "_i", F.when(place >= 1, F.get("s", (place - 1).cast("int"))).alias("hit")).collect()}
    hits = [(p.group, p.asks[0][0], found[i]["_v"], found[i]["_id"])
            for i, p in enumerate(parts) if found.get(i)]
    missed = [(p.group, p.asks[0][0]) for i, p in enumerate(parts) if not found.get(i)]
    if missed:
        hits += _search(rows, missed, by, clamp=True, with_id=True)
    return _found(df, by, T.LongType(), hits, ids=True)


def _spread(df: DataFrame, values: list[str], by: list[str], rows: int | None = None
            ) -> tuple[int, DataFrame]:
    """(number of buckets, settled table (by..., _b0, _b1, ...) of their bounds), in one job.

    The bounds are quantiles of the values per group; a second job is run only where so many rows
    need more buckets than the first sketch has points.
    """
    def sketched(points: int):
        grid = _grid([i / points for i in range(1, points)])
        return [F.expr(f"percentile_approx(`{v}`, {grid}, {ACCURACY})").alias(f"_b{j}")
                for j, v in enumerate(values)]

    points = BUCKETS if rows is None else bucket_count(rows)
    table = settle(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *sketched(points)), bound=500)
    if rows is not None:
        return points, table.drop("_n")
    buckets = bucket_count(table.agg(F.sum("_n")).first()[0] or 0)
    if buckets > points:
        return buckets, settle(df.groupBy(*by).agg(*sketched(buckets)), bound=500)
    every = [F.lit(i) for i in range(points // buckets - 1, points - 1, points // buckets)]
    picked = [F.when(F.col(f"_b{j}").isNotNull(), F.array(*[F.get(f"_b{j}", i) for i in every]))
              .alias(f"_b{j}") for j in range(len(values))]
    return buckets, table.select(*by, *picked)


def rank_all(df: DataFrame, value: str, id_col: str, by: list[str] | None = None,
             ascending: bool = True, out: str = "rank", rows: int | None = None) -> DataFrame:
    """1-based position of every row in (value, id) order, per group; ids are not null.

    Rows are bucketed by sketched bounds; a value that fills whole buckets (a hot tie) gets a
    bucket of its own and is split further by id. Bucket counts give the offsets, and the sort
    runs inside buckets. ``rows`` is the number of rows, if the caller knows it.
    """
    by = list(by or [])
    order = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    full = filled(df, value, "_v")
    buckets, bounds = _spread(full, ["_v", id_col], by, rows)
    bounded = locate(attach(full, bounds, by), "_b0", "_v", "_z", buckets - 1)
    tie = F.coalesce(F.get("_b0", F.col("_z")) == F.col("_v"), F.lit(False))
    bounded = bounded.withColumn("_z", F.col("_z") * 2 + tie.cast("int")).drop("_b0")
    ids = locate(bounded, "_b1", id_col, "_s", buckets - 1).drop("_b1")
    split = ids.withColumn("_s", F.when(F.col("_z") % 2 == 1, F.col("_s")).otherwise(0))
    running = W.partitionBy(*by).orderBy(order("_z"), order("_s"))
    counts = settle(split.groupBy(*by, "_z", "_s").agg(F.count(F.lit(1)).alias("_c")))
    offsets = counts.withColumn("_before", F.sum("_c").over(running) - F.col("_c")).drop("_c")
    place = F.row_number().over(
        W.partitionBy(*by, "_z", "_s").orderBy(order("_v"), order(id_col))
    )
    return (
        joined(split, offsets, [*by, "_z", "_s"])
        .withColumn(out, (F.col("_before") + place).cast("bigint"))
        .drop("_z", "_s", "_before", "_v")
    )


def prefix_sums(cells: DataFrame, value: str, sums: list[str], by: list[str] | None = None,
                ascending: bool = True, shared_bounds: bool = False) -> DataFrame:
    """Running totals of ``sums`` up to and including each row, as ``cum_<name>``.

    ``cells`` has one row per (group, value). If they fit the driver (``SMALL_ROWS``) they become
    part of the plan; else they are staged, dealt to buckets by value, and summed inside these.
    ``shared_bounds`` takes one set of bucket bounds for all groups, for groups that spread alike
    such as bootstrap replicates.
    """
    by = list(by or [])
    order = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    keys = [] if shared_bounds else by
    spark, table = cells.sparkSession, collected(cells)
    if table is not None:  # few distinct values: their sums need no buckets
        few = filled(spark.createDataFrame(table, schema=cells.schema), value, "_v")
        whole = W.partitionBy(*by).orderBy(order("_v"))
        return few.select(*cells.columns, *[F.sum(s).over(whole).alias(f"cum_{s}") for s in sums])
    full = filled(stage(cells, "cells"), value, "_v")
    buckets, bounds = _spread(full, ["_v"], keys)
    rows = locate(attach(full, bounds, keys), "_b0", "_v", "_z", buckets - 1).drop("_b0")
    totals = settle(rows.groupBy(*by, "_z").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums]))
    running = W.partitionBy(*by).orderBy(order("_z"))
    totals = totals.select(
        *by, "_z", *[(F.sum(f"_t_{s}").over(running) - F.col(f"_t_{s}")).alias(f"_o_{s}")
                     for s in sums]
    )
    inner = W.partitionBy(*by, "_z").orderBy(order("_v"))
    rows = joined(rows, totals, [*by, "_z"])
    return rows.select(
        *cells.columns,
        *[(F.col(f"_o_{s}") + F.sum(s).over(inner)).alias(f"cum_{s}") for s in sums],
    )


def dense_position(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """0-based position in the order of the unique key ``order``; nulls come first.

    Rows are dealt by ranges of the key, which is unique, so no range is hot, and sorted inside;
    they are staged once with a number that rises within a range. The ranges' counts, one number
    each, turn that number into the position, so the result is a plain projection of a stored table.
    """
    place = F.monotonically_increasing_id()
    ranged = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", place), "ranged")
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["p"]: (r["n"], r["first"]) for r in ranged.groupBy(part.alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).collect()}
    shifts, before = [], 0
    for p in range(max(sizes, default=-1) + 1):
        n, first = sizes.get(p, (0, 0))
        shifts.append(before - first)
        before += n
    shift = F.get(F.expr("array(" + ", ".join(f"{x}L" for x in shifts) + ")"), part) if shifts \
        else F.lit(0)
    return ranged.withColumn(out, (F.col("_at") + shift).cast("bigint")).drop("_at")


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None):
    """Exact quantiles with linear interpolation per group: (by..., prob, quantile).

    Nulls are left out; a group without values has no row. Groups and probabilities are few.
    """
    by = list(by or [])
    rows = df.select(*by, F.col(value).alias("_v"), F.lit(0).cast("bigint").alias("_id")).where(
        F.col("_v").isNotNull())
    parts, wanted = [], []
    for r in rows.groupBy(*by).agg(*_sketch("_v")).collect():
        if not r["n"]:
            continue
        group = tuple(r[c] for c in by)
        places = [(float(p), p * (r["n"] - 1)) for p in probs]
        ranks = {k for _, at in places for k in (floor(at) + 1, ceil(at) + 1)}
        part = _Part(group, [(k, k) for k in sorted(ranks)], r["n"])
        _edged(part, r["b"])
        parts.append(part)
        wanted += [(group, p, at) for p, at in places]
    found = {(g, k): v for g, k, v, _ in _narrowed(rows, parts, by, with_id=False)}
    out = []
    for group, p, at in wanted:
        low, high = float(found[group, floor(at) + 1]), float(found[group, ceil(at) + 1])
        out.append((*group, p, low + (high - low) * (at - floor(at))))
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("prob", T.DoubleType()),
                           T.StructField("quantile", T.DoubleType())])
    return small_table(df.sparkSession, out, schema)
