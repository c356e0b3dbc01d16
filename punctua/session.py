"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Tables up to this many rows may be collected and shipped with the plan; larger ones stay
# distributed, so the bound never changes a result.
SMALL_ROWS = 100_000


def build_session(app: str = "punctua", cpus: str | None = None, partitions: int | None = None):
    """A local session for tests and benchmarks; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables, as named by the session.

    A machine-local folder is chosen only for a local master without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    folder = tempfile.mkdtemp(prefix="punctua-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the work folder."""
    return f"{work_dir(spark)}/punctua-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to Parquet in the work folder and read it back.

    Cuts lineage and survives lost executors; later passes over the table read only the
    columns they need.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A driver-made table as part of the plan, so that Catalyst knows how small it is.

    Made from a plain list it would have an unknown size, and a join would shuffle both sides.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    listed = [dict(zip(kind.names, row)) for row in rows]
    table = pa.Table.from_pylist(listed, schema=to_arrow_schema(kind))
    return spark.createDataFrame(table, schema=kind)


def collected(df: DataFrame, bound: int = SMALL_ROWS) -> pa.Table | None:
    """The rows of a table that is expected to be small; None if it has more than ``bound``."""
    table = df.limit(bound + 1).toArrow()
    return table if table.num_rows <= bound else None


def settle(df: DataFrame, bound: int = SMALL_ROWS) -> DataFrame:
    """Evaluate a table that is expected to be small (statistics per group, cut points).

    Up to ``bound`` rows it becomes part of the plan, so Catalyst knows its size and may
    broadcast it. A larger table is checkpointed and joined by shuffle instead.
    """
    spark = df.sparkSession
    table = collected(df, bound)
    if table is not None:
        return spark.createDataFrame(table, schema=df.schema)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_dir(spark))
    return df.checkpoint()
