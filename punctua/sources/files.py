"""CSV and ZIP exports as DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctua.functions.columns import NA_TOKENS, blank_to_null
from punctua.sources import streams

# The 21 columns of the monthly carrier x airport table, in file order.
CANONICAL = [
    "year", "month", "carrier", "carrier_name", "airport", "airport_name", "arr_flights",
    "arr_del15", "carrier_ct", "weather_ct", "nas_ct", "security_ct", "late_aircraft_ct",
    "arr_cancelled", "arr_diverted", "arr_delay", "carrier_delay", "weather_delay",
    "nas_delay", "security_delay", "late_aircraft_delay",
]


def _listing(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.lower("path").alias("_p"))


def discover(spark: SparkSession, path: str) -> list[str]:
    """Input files under ``path``, sorted: its CSV files if there is any, else its ZIP files."""
    try:
        listed = _listing(spark, path)
    except AnalysisException as error:
        raise FileNotFoundError(f"There is nothing at {path}.") from error
    for suffix in (".csv", ".zip"):
        found = listed.where(F.col("_p").endswith(suffix)).select("path").orderBy("path")
        names = [row.path for row in found.toLocalIterator()]
        if names:
            return names
    if listed.where(F.col("path").endswith(path.rstrip("/"))).limit(1).count():
        raise ValueError(f"{path} is neither a CSV or ZIP file nor a folder of them.")
    raise FileNotFoundError(f"{path} has no file that ends in .csv or .zip.")


def clean_name(name: str) -> str:
    """Lower-case column name with spaces and hyphens as underscores, without a BOM."""
    return re.sub(r"[ -]", "_", name.replace("﻿", "").strip().lower())


def normalize_schema(df: DataFrame) -> DataFrame:
    """Clean the column names, drop unnamed columns, name a headerless layout by position."""
    named = [(i, clean_name(c)) for i, c in enumerate(df.columns)]
    kept = [(i, c) for i, c in named if not re.fullmatch(r"_c\d+|unnamed:.*", c)]
    names = [c for _, c in kept]
    head = names[: len(CANONICAL)]
    coded = all(c.isdigit() or c.startswith("x") for c in head)
    if not set(CANONICAL) <= set(names) and len(head) == len(CANONICAL) and coded:
        names = CANONICAL + names[len(CANONICAL):]
    twice = sorted({c for c in names if names.count(c) > 1})
    if twice:
        raise ValueError(f"Columns occur twice after cleaning: {twice}")
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{i}").alias(c) for (i, _), c in zip(kept, names)])


def header_lines(spark: SparkSession, files: list[str]) -> Iterator[Row]:
    """(path, header): the first line of every file that is not blank, null if there is none.

    A task opens a file, reads the line and stops, so the cost does not depend on the sizes.
    """
    return streams.scan(spark, streams.Headers, sorted(files)).orderBy("path").toLocalIterator()


def read_csv(spark: SparkSession, files: list[str], multiline: bool = False) -> DataFrame:
    """All columns as text. Files are aligned by column name, not by position.

    Spark assigns the values of a multi-file read by position under the first header, so files
    are grouped by their header line and each group is one scan: the number of scans is the
    number of different headers, not of files.
    """
    groups: dict[str, list[str]] = {}
    for row in header_lines(spark, files):
        if row.header is not None:
            groups.setdefault(row.header, []).append(row.path)
    if not groups:
        raise ValueError("The CSV files have no header line.")
    reader = spark.read.option("header", True).option("escape", '"')
    reader = reader.option("multiLine", multiline)
    return _align([normalize_schema(reader.csv(paths)) for paths in groups.values()])


def _kept_names(header: list[str]) -> list[str]:
    """Cleaned names of a member's columns; those without a name stay as _c<position>."""
    names = [clean_name(n) or f"_c{i}" for i, n in enumerate(header)]
    twice = sorted({c for c in names if names.count(c) > 1})
    if twice:
        raise ValueError(f"Columns occur twice after cleaning: {twice}")
    return names


def read_zip(spark: SparkSession, files: list[str]) -> DataFrame:
    """Every ``.csv`` member of the archives as text, aligned by name.

    The headers come from the archives' directories and first lines. Then each member is one
    partition of one scan, which is decompressed as a stream and leaves in batches.
    """
    members, names = [], []
    for r in streams.scan(spark, streams.Members, sorted(files)).orderBy("path", "member").collect():
        if r.header is not None:
            own = _kept_names(json.loads(r.header))
            members.append([r.path, r.member, own])
            names += [n for n in own if n not in names]
    if not members:
        raise ValueError("The CSV files have no header line.")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return normalize_schema(streams.scan(spark, streams.Zip, members, schema))


def _align(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_raw(spark: SparkSession, path: str, na_tokens: list[str] | None = None) -> DataFrame:
    """Raw table as text columns, missing-value texts as null, columns aligned by name.

    The default tokens include ``NA``, so a carrier code ``NA`` is read as missing; pass
    ``na_tokens=[]`` to keep it.
    """
    files = discover(spark, path)
    read = read_csv if files[0].lower().endswith(".csv") else read_zip
    tokens = NA_TOKENS if na_tokens is None else na_tokens
    raw = read(spark, files)
    return raw.select(*[blank_to_null(c, tokens) for c in raw.columns])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, length and SHA-256 of every file; files are read in chunks, whatever their size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    names = [r.path for r in files.select("path").orderBy("path").toLocalIterator()]
    return streams.scan(spark, streams.Digests, names)
