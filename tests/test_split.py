import pytest
from pyspark.sql import functions as F

from punctua.operators import split


def test_published_counts():
    counts = {0: 211064, 1: 161066}
    assert split.largest_remainder(counts, 74426) == {0: 42213, 1: 32213}


def test_split_and_balance_sizes(spark):
    rows = spark.range(503).select("id", (F.col("id") % 10 < 3).cast("int").alias("target"))
    parts = split.balance(split.random_split(rows, 0.2, "s", "id"), "b", "id").persist()
    assert parts.where("part = 'test'").count() == 101
    kept = parts.where("part = 'train' and kept").groupBy("target").count().collect()
    assert len({r["count"] for r in kept}) == 1
    assert parts.where("part = 'test' and not kept").count() == 0


def test_folds_are_even(spark):
    rows = spark.range(101).select("id", (F.col("id") % 3 == 0).cast("int").alias("target"))
    folded = split.stratified_folds(rows, 4, "s", "id").persist()
    assert sorted(r["count"] for r in folded.groupBy("fold").count().collect()) == [25, 25, 25, 26]
    per_class = folded.groupBy("target", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in per_class if r.target == label]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == 4
    with pytest.raises(ValueError):
        split.stratified_folds(rows, 60, "s", "id")


def test_temporal_errors_and_subsample(spark):
    rows = spark.createDataFrame([(1, 2000, 0), (2, 2001, 1)], "id long, year int, target int")
    with pytest.raises(ValueError, match="overlap"):
        split.temporal_split(rows, 2001, 2001)
    with pytest.raises(ValueError, match="empty"):
        split.require_parts(split.temporal_split(rows, 2001, 2002))
    assert split.subsample(rows, None, "s", "id").count() == 2
    assert split.subsample(rows, 1, "s", "id").count() == 1
