"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return rows
with the columns of ``documents``. Null and empty texts pass the first stage by their score, and
the others unchanged. A stage's result is to be written before the next stage is called, as its
documents are then read from there: what the stage before staged on its way is removed first.
Repeated rows are documents of their own until the Jaccard join, where
rows with other ids than their component's smallest go.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.llm import decontaminate, jaccard, packing, quality, runs, suffixes
from punctua.session import stage as written

_left: dict[str, list[str]] = {}  # folders that the last stage of an application staged


def _alone(function: Callable) -> Callable:
    """A stage that begins by removing what the stage before it staged and shuffled."""
    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = spark.sparkContext.applicationId
        runs.removed(spark, _left.pop(key, []))
        runs.released(spark)
        with runs.scope() as folders:
            out = function(spark, docs, sf_dir)
        _left[key] = folders
        return out

    return run


@_alone
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_alone
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words, similarity 0.8."""
    return jaccard.kept_rows(docs, size=5, percent=80)


@_alone
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes that a document with a smaller id holds."""
    cut = suffixes.cut_texts(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast(
            cut.schema["n_chars"].dataType), F.col("n_chars")))
    return cut.select(docs.columns)


@_alone
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_alone
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2,048 words."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None  # a fitted model, byte passages and bins are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
