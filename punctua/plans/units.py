"""The unit table and its derivatives on the given tables."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctua.operators import order, prepare, selection, split
from punctua.session import settle, small_table, stage, work_path  # noqa: F401

RULES = prepare.Rules(start=(1992, 1), end=(2025, 1))
SPLIT_SEED, BALANCE_SEED, VALUE_SEED, MANDATORY_SEED = "split42", "under42", "value42", "mand42"
RANDOM_SEED = "random42"
PENALTY, CAPACITY, GROUP_FRACTION, MANDATORY_FRACTION = 2000.0, 0.60, 0.40, 0.05
PENALTIES = [1000.0, 2000.0, 3000.0, 4000.0]
CAPACITIES = [0.40, 0.50, 0.60, 0.70, 0.80]
TRAIN_END, TEST_START = 1999, 2000
KEY = ["year", "month", "carrier", "airport"]


_SCHEMAS: dict[str, T.StructType] = {}
_PER_LINE = ContextVar("per_line", default=False)


@contextmanager
def per_line():
    """Inside, a unit is an order line, so the unit table grows with the given tables."""
    token = _PER_LINE.set(True)
    try:
        yield
    finally:
        _PER_LINE.reset(token)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is inferred from the footers once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def raw_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship month x market segment x customer nation, with a late count (no ids yet)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    places = orders.join(cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")),
                         F.col("o_custkey") == F.col("c_custkey"))
    rows = line.join(places, F.col("l_orderkey") == F.col("o_orderkey"))
    month = F.month("l_shipdate")
    season = F.when(month.isin(1, 6, 7, 12), 4).otherwise(0)
    late = F.col("l_quantity") > 42 - 3 * (F.col("c_nationkey") % 5) - season
    return rows.groupBy(
        F.year("l_shipdate").alias("year"), month.alias("month"),
        F.col("c_mktsegment").alias("carrier"), F.col("n_name").alias("airport"),
    ).agg(
        F.count(F.lit(1)).cast("double").alias("arr_flights"),
        F.count_if(late).cast("double").alias("arr_del15"),
    )


def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a share of late pieces; lines of one number in an order are one unit."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("day"), F.min("l_returnflag").alias("carrier"),
        F.min(F.col("l_suppkey") % 50).alias("place"), F.sum("l_quantity").alias("arr_flights"))
    share = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("place")) % 40
    return rows.select(
        "l_orderkey", "l_linenumber", F.year("day").alias("year"), F.month("day").alias("month"),
        "carrier", F.concat(F.lit("s"), F.col("place").cast("string")).alias("airport"),
        "arr_flights", F.floor(F.col("arr_flights") * share / 100).cast("double").alias("arr_del15"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit table with ``unit_id``, the position in key order: a projection of a staged table,
    so that the aggregate runs once however many passes follow."""
    if _PER_LINE.get():
        key = ["l_orderkey", "l_linenumber"]
        return order.dense_position(line_units(spark, sf_dir), key, "unit_id").drop(*key)
    return order.dense_position(raw_units(spark, sf_dir), KEY, "unit_id")


def event_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second unit table: day x event type x user group; late means a value above 80."""
    rows = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("day"), "event_type", (F.col("user_id") % 50).alias("grp"), "value"
    )
    return rows.groupBy("day", "event_type", "grp").agg(
        F.count(F.lit(1)).cast("double").alias("arr_flights"),
        F.count_if(F.col("value") > 80).cast("double").alias("arr_del15"),
    )


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit table as text with blanks, bad numbers, zero counts and contradictions."""
    uid = F.col("unit_id")

    def text(name):
        return F.col(name).cast("string")

    return units(spark, sf_dir).select(
        "unit_id", text("year").alias("year"), text("month").alias("month"),
        F.when(uid % 107 != 0, F.col("carrier")).alias("carrier"), "airport",
        F.when(uid % 101 == 0, "x").when(uid % 103 == 0, "0").otherwise(text("arr_flights"))
        .alias("arr_flights"),
        F.when(uid % 97 != 0, text("arr_del15")).alias("arr_del15"),
        F.when(uid % 9700 == 0, "15").otherwise("0").alias("arr_delay"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.prepare_rows(units(spark, sf_dir), RULES)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled units with ``part`` and ``kept`` (balanced training side), staged."""
    rows = split.random_split(labelled(spark, sf_dir), 0.2, SPLIT_SEED, "unit_id")
    return stage(split.balance(rows, BALANCE_SEED, "unit_id"), "parts")


def temporal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.temporal_split(labelled(spark, sf_dir), TRAIN_END, TEST_START)
    split.require_parts(rows)
    return stage(split.balance(rows, BALANCE_SEED, "unit_id"), "temporal")


def train_of(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("part") == "train") & F.col("kept"))


def test_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("part") == "test")


def prior_scores(rows: DataFrame) -> DataFrame:
    """Test rows with the smoothed training rate of their (carrier, airport)."""
    rate = settle(train_of(rows).groupBy("carrier", "airport").agg(
        ((F.sum("target") + F.lit(1.0)) / (F.count(F.lit(1)) + F.lit(2.0))).alias("_rate")
    ))
    return test_of(rows).join(rate, ["carrier", "airport"], "left").withColumn(
        "probability", F.coalesce("_rate", F.lit(0.5))
    ).drop("_rate")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test units with probability and commercial value, staged."""
    rows = selection.commercial_values(
        prior_scores(parts(spark, sf_dir)), 1000, 5000, VALUE_SEED
    )
    return stage(
        rows.select("unit_id", *KEY, "arr_flights", "target", "probability", "value"), "scored"
    )
