"""Exact splits, balancing, folds and draws by a portable seeded hash.

Sizes and class counts are exact. Which rows are drawn depends on (seed, id) alone, so a
rerun, another partitioning or a lost executor gives the same rows.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctua.functions.columns import seeded_hash
from punctua.operators import order
from punctua.operators.prepare import class_counts
from punctua.session import settle, small_table


def _counts(df: DataFrame, target: str) -> dict:
    rows = settle(class_counts(df, target)).collect()
    return {r[target]: r["rows"] for r in sorted(rows, key=lambda r: r[target])}


def largest_remainder(counts: dict, total: int) -> dict:
    """Whole-number shares of ``total`` in proportion to the class counts.

    Remainders are compared as integers; an equal remainder goes to the smaller class label.
    """
    size = sum(counts.values())
    share = {c: n * total // size for c, n in counts.items()}
    rest = total - sum(share.values())
    by_remainder = sorted(counts, key=lambda c: (-(counts[c] * total % size), c))
    return {c: share[c] + (c in by_remainder[:rest]) for c in counts}


def _quota_table(df: DataFrame, target: str, quotas: dict, counts: dict | None = None):
    kind = df.schema[target].dataType
    fields = [T.StructField(target, kind), T.StructField("k", T.LongType())]
    rows = [(c, int(k)) for c, k in quotas.items()]
    if counts:  # the draw need not count the rows again
        fields.append(T.StructField("n", T.LongType()))
        rows = [(c, k, counts[c]) for c, k in rows]
    return small_table(df.sparkSession, rows, T.StructType(fields))


def stratified_draw(df: DataFrame, rows: int, seed: str, id_col: str, target: str = "target",
                    out: str = "drawn", counts: dict | None = None) -> DataFrame:
    """Mark exactly ``rows`` rows, spread over the classes by largest remainder."""
    counts = counts or _counts(df, target)
    quotas = _quota_table(df, target, largest_remainder(counts, rows), counts)
    return order.first_by_hash(df, id_col, seed, quotas, [target], out)


def random_split(df: DataFrame, test_size: float, seed: str, id_col: str,
                 target: str = "target") -> DataFrame:
    """Stratified split: a column ``part`` with ceil(n * test_size) test rows."""
    counts = _counts(df, target)
    rows = ceil(sum(counts.values()) * float(test_size))
    drawn = stratified_draw(df, rows, seed, id_col, target, "_test", counts)
    return drawn.withColumn("part", F.when(F.col("_test"), "test").otherwise("train")).drop(
        "_test"
    )


def temporal_split(df: DataFrame, train_end: int, test_start: int) -> DataFrame:
    """Years up to ``train_end`` train, from ``test_start`` test; years between are left out."""
    if train_end >= test_start:
        raise ValueError("Training years overlap the test years.")
    part = F.when(F.col("year") <= train_end, "train").when(F.col("year") >= test_start, "test")
    kept = df.where((F.col("year") <= train_end) | (F.col("year") >= test_start))
    return kept.withColumn("part", part)


def require_parts(df: DataFrame) -> None:
    seen = df.agg(F.count_if(F.col("part") == "train").alias("train"),
                  F.count_if(F.col("part") == "test").alias("test")).first()
    if not seen["train"] or not seen["test"]:
        raise ValueError("The split has an empty train or test part.")


def undersample(df: DataFrame, seed: str, id_col: str, target: str = "target") -> DataFrame:
    """Mark as many rows of each class as the smallest class has."""
    counts = _counts(df, target)
    quotas = _quota_table(df, target, {c: min(counts.values()) for c in counts}, counts)
    return order.first_by_hash(df, id_col, seed, quotas, [target], "kept")


def balance(df: DataFrame, seed: str, id_col: str, target: str = "target") -> DataFrame:
    """Undersample the training part only; every test row is kept."""
    train = F.col("part") == "train"
    sizes = settle(df.groupBy("part", target).agg(F.count(F.lit(1)).alias("n"))).collect()
    counts = {r[target]: r["n"] for r in sizes if r["part"] == "train"}
    kind = df.schema[target].dataType
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField(target, kind),
                           T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
    quotas = small_table(
        df.sparkSession, [("train", c, min(counts.values()), n) for c, n in counts.items()], schema
    )
    marked = order.first_by_hash(df, id_col, seed, quotas, ["part", target], "kept")
    return marked.withColumn("kept", F.col("kept") | ~train)


def stratified_folds(df: DataFrame, folds: int, seed: str, id_col: str,
                     target: str = "target", out: str = "fold") -> DataFrame:
    """K-fold number per row, balanced within one row per class and in total.

    Classes are laid end to end and dealt out in turn: the fold is the position modulo the
    number of folds, where a class is ordered by the seeded hash.
    """
    counts = _counts(df, target)
    if folds < 2 or min(counts.values()) < folds:
        raise ValueError("Every class needs at least one row per fold, and two folds or more.")
    offset, start = F.lit(0), 0
    for label, rows in counts.items():
        offset = F.when(F.col(target) == F.lit(label), F.lit(start)).otherwise(offset)
        start += rows
    ranked = order.rank_all(
        df.withColumn("_h", seeded_hash(seed, id_col)), "_h", id_col, [target], out="_r",
        rows=sum(counts.values()),
    )
    fold = ((offset + F.col("_r") - 1) % folds).cast("int")
    return ranked.withColumn(out, fold).drop("_h", "_r")


def subsample(df: DataFrame, rows: int | None, seed: str, id_col: str,
              target: str = "target") -> DataFrame:
    """Stratified sample of exactly ``rows`` rows; the whole table if it has no more."""
    counts = _counts(df, target)
    if rows is None or rows >= sum(counts.values()):
        return df
    drawn = stratified_draw(df, rows, seed, id_col, target, "_in", counts)
    return drawn.where("_in").drop("_in")


def holdout(df: DataFrame, seed: str, id_col: str, fraction: float = 0.10,
            target: str = "target") -> DataFrame:
    """Mark the early-stopping holdout of a training fold as ``is_validation``."""
    counts = _counts(df, target)
    rows = ceil(sum(counts.values()) * float(fraction))
    return stratified_draw(df, rows, seed, id_col, target, "is_validation", counts)


def draw(df: DataFrame, seed: str, id_col: str, fraction: float | None = None,
         rows: int | None = None, out: str = "drawn") -> DataFrame:
    """Mark floor(n * fraction) or ``rows`` rows (all, if there are fewer), each once."""
    n = df.count()
    if rows is None:
        if fraction is None or not 0 <= fraction <= 1:
            raise ValueError("The fraction lies in [0, 1].")
        rows = floor(n * float(fraction))
    quotas = small_table(df.sparkSession, [(rows, n)], "k bigint, n bigint")
    return order.first_by_hash(df, id_col, seed, quotas, [], out)
