"""Writers that never overwrite (K1-K3, K5); models are saved by operators.stored (K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    """CSV with header; gzip for row-level tables."""
    writer = df.write.mode("errorifexists").option("header", True)
    if compress:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def write_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, the default for row-level tables."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON lines."""
    df.write.mode("errorifexists").json(path)


def write_predictions(df: DataFrame, path: str, model: str) -> None:
    """Predictions of one model in a folder of its own; a second write is an error.

    The committer moves the files in place at the end, so a reader sees all or nothing.
    """
    write_rows(df, f"{path}/model={model}")
