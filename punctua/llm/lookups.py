"""A join of many rows to one row per key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctua.session import settle


def lookup(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each value of ``on``.

    A key is hot if it holds more than 1 / (4 P) of ``rows``, P being the shuffle partitions; so
    there are fewer than 4 P of them and their rows of ``table`` can be broadcast, while the rows of
    a hot key stay where they are. All others go through a shuffle, where no key is large.
    ``rows`` is read several times: stage it first. Keys are not null.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count()
    hot = settle(rows.groupBy(on).count().where(F.col("count") * (4 * parts) > total).select(on),
                 4 * parts)
    if hot.isEmpty():
        return rows.join(table, on, how)
    few = settle(table.join(F.broadcast(hot), on, "left_semi"), 4 * parts)
    rest = rows.join(F.broadcast(hot), on, "left_anti").join(table, on, how)
    return rest.unionByName(
        rows.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how))
