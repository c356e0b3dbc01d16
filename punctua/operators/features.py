"""Feature encodings with statistics from training rows only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctua.operators import order
from punctua.operators.prepare import CATEGORICAL, NUMERIC
from punctua.session import collected, settle

ORDINAL = [f"x_{c}" for c in CATEGORICAL + NUMERIC]
SCALED = [f"z_{c}" for c in CATEGORICAL + NUMERIC]


def _numbered(dictionary: DataFrame, column: str, out: str) -> DataFrame:
    """Positions in sorted order; a dictionary that fits the driver is sorted there."""
    table = collected(dictionary)
    if table is None:
        return settle(order.dense_position(dictionary, [column], out))
    table = table.sort_by(column)
    table = table.append_column(out, pa.array(range(table.num_rows), pa.int64()))
    schema = T.StructType([*dictionary.schema.fields, T.StructField(out, T.LongType())])
    return dictionary.sparkSession.createDataFrame(table, schema=schema)


def category_codes(train: DataFrame, column: str) -> DataFrame:
    """Sorted dictionary (column, rows, code): one row per category, codes from 0."""
    return _numbered(train.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("rows")), column, "code")


def category_slots(codes: DataFrame, column: str, min_rows: int = 2) -> DataFrame:
    """One-hot slots: frequent categories in sorted order, the rare ones share the last slot."""
    often = codes.where(F.col("rows") >= min_rows)
    rare = codes.where(F.col("rows") < min_rows)
    ranked = _numbered(often, column, "slot").select(column, "slot")
    return settle(
        ranked.unionByName(rare.select(column, F.lit(often.count()).cast("bigint").alias("slot")))
    )


def medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians, ignoring nulls; all columns in one pass over their long form."""
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
        for c in columns
    ])).alias("r")).select("r.name", "r.value")
    found = {r["name"]: r["quantile"]
             for r in order.quantiles(long, "value", [0.5], ["name"]).collect()}
    return {c: found[c] for c in columns if c in found}


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; a constant column divides by 1."""
    aggs = [f(c).alias(f"{k}_{c}") for c in columns
            for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


@dataclass(frozen=True)
class Ordinal:
    """Sorted category codes (unknown is -1) and median-filled numbers, as x_<name>."""

    codes: dict[str, DataFrame]
    fill: dict[str, float]
    scale: dict[str, tuple[float, float]] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        # Dictionaries are settled tables of known size: Catalyst broadcasts them while they
        # are small, and a join of one row per key splits a hot key otherwise.
        for name, codes in self.codes.items():
            lookup = codes.select(name, F.col("code").cast("double").alias(f"x_{name}"))
            df = df.join(lookup, name, "left").withColumn(
                f"x_{name}", F.coalesce(f"x_{name}", F.lit(-1.0))
            )
        df = df.withColumns({
            f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.fill.items()
        })
        if self.scale is None:
            return df
        return df.withColumns({
            f"z_{c[2:]}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.scale.items()
        })


def fit_ordinal(train: DataFrame, scaled: bool = False) -> Ordinal:
    codes = {c: category_codes(train, c) for c in CATEGORICAL}
    encoding = Ordinal(codes, medians(train, NUMERIC))
    if not scaled:
        return encoding
    return Ordinal(encoding.codes, encoding.fill, moments(encoding.transform(train), ORDINAL))


def one_hot_long(df: DataFrame, slots: dict[str, DataFrame], id_col: str) -> DataFrame:
    """Long one-hot form (id, feature, slot); an unknown category has no row."""
    parts = [
        df.select(id_col, c).join(table, c).select(id_col, F.lit(c).alias("feature"), "slot")
        for c, table in slots.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class OneHot:
    """Sparse one-hot categories followed by scaled, median-filled numbers, as ``features``."""

    slots: dict[str, DataFrame]
    widths: dict[str, int]
    fill: dict[str, float]
    scale: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        for name, table in self.slots.items():
            # The unknown slot is the last one, which the encoder leaves out: all zeros.
            width = self.widths[name]
            meta = {"ml_attr": {"type": "nominal", "num_vals": width + 1, "name": name}}
            index = F.coalesce(F.col("slot").cast("double"), F.lit(float(width)))
            df = df.join(table, name, "left")
            df = df.withColumn(f"i_{name}", index.alias(f"i_{name}", metadata=meta)).drop("slot")
        df = df.withColumns({
            f"z_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(self.scale[c][0]))
            / F.lit(self.scale[c][1]) for c, m in self.fill.items()
        })
        names = list(self.slots)
        hot = OneHotEncoder(
            inputCols=[f"i_{c}" for c in names], outputCols=[f"h_{c}" for c in names],
            dropLast=True, handleInvalid="error",
        ).fit(df)
        columns = [f"h_{c}" for c in names] + [f"z_{c}" for c in self.fill]
        return VectorAssembler(inputCols=columns, outputCol="features").transform(
            hot.transform(df)
        )


def fit_one_hot(train: DataFrame) -> OneHot:
    slots = {c: category_slots(category_codes(train, c), c) for c in CATEGORICAL}
    widths = {c: t.agg(F.max("slot")).first()[0] + 1 for c, t in slots.items()}
    fill = medians(train, NUMERIC)
    filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c)
                            for c, m in fill.items()])
    return OneHot(slots, widths, fill, moments(filled, NUMERIC))


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric feature vector: ordinal codes stay plain numbers, without nominal metadata."""
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)
