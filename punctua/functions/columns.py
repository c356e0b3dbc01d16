"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts a pandas CSV reader takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

HASH_BITS = 48


def seeded_hash(seed: str, key: str | Column) -> Column:
    """Uniform 48-bit integer from a seed and a key; the same in every engine with md5."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}|"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def to_number(name: str, dtype: T.DataType) -> Column:
    """Double value of a column; anything that is not a finite number becomes null."""
    col = F.col(name)
    if isinstance(dtype, T.StringType):
        number = F.when(col.rlike(NUMBER), F.trim(col).try_cast("double"))
    else:
        number = col.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def blank_to_null(name: str, tokens: list[str]) -> Column:
    """Null where the text is one of the missing-value tokens."""
    if not tokens:
        return F.col(name)
    return F.when(~F.col(name).isin(tokens), F.col(name)).alias(name)


def month_index(year: str = "year", month: str = "month") -> Column:
    return F.col(year).cast("int") * 12 + F.col(month).cast("int")


def period_text(year: Column, month: Column) -> Column:
    return F.date_format(F.make_date(year.cast("int"), month.cast("int"), F.lit(1)), "yyyy-MM")
