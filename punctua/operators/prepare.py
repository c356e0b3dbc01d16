"""Cleaning, validation and labelling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctua.functions.columns import month_index, period_text, to_number
from punctua.sources.files import CANONICAL

REQUIRED = ["year", "month", "carrier", "airport", "arr_flights", "arr_del15"]
ESSENTIAL = ["year", "month", "carrier", "airport", "arr_flights"]
EVIDENCE = ["arr_delay", "carrier_ct", "weather_ct", "nas_ct", "security_ct", "late_aircraft_ct"]
FEATURES = ["year", "month", "carrier", "airport", "arr_flights"]
CATEGORICAL = ["carrier", "airport"]
NUMERIC = ["year", "month", "arr_flights"]
OUTCOMES = sorted(set(CANONICAL) - set(FEATURES))


@dataclass(frozen=True)
class Rules:
    """What makes a row valid and positive."""

    threshold: float = 0.20
    missing: str = "zero"
    start: tuple[int, int] = (2005, 1)
    end: tuple[int, int] = (2025, 1)

    def __post_init__(self):
        if self.missing not in ("zero", "drop"):
            raise ValueError("The missing-outcome policy is 'zero' or 'drop'.")
        if not 0 <= self.threshold <= 1:
            raise ValueError("The threshold is a rate in [0, 1].")


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def coerce(df: DataFrame) -> DataFrame:
    """Numbers for year, month and the two counts; bad text becomes null."""
    require_columns(df, REQUIRED)
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = {c: to_number(c, types[c]) for c in ("year", "month", "arr_flights", "arr_del15")}
    return df.withColumns(numbers)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=ESSENTIAL)


def is_conflict(df: DataFrame) -> Column:
    """A missing outcome next to positive delay evidence, over the evidence columns present."""
    types = {f.name: f.dataType for f in df.schema.fields}
    found = F.lit(False)
    for name in (c for c in EVIDENCE if c in types):
        found = found | (F.coalesce(to_number(name, types[name]), F.lit(0.0)) > 0)
    return F.col("arr_del15").isNull() & found


def conflicts(df: DataFrame) -> DataFrame:
    """Coerced, complete rows whose missing outcome contradicts their delay evidence."""
    return df.where(is_conflict(df))


def fill_outcome(df: DataFrame, rules: Rules) -> DataFrame:
    if rules.missing == "zero":
        return df.withColumn("arr_del15", F.coalesce("arr_del15", F.lit(0.0)))
    return df.dropna(subset=["arr_del15"])


def in_period(rules: Rules) -> Column:
    """Inclusive month range; the bounds on the year alone let partitions be pruned."""
    low = rules.start[0] * 12 + rules.start[1]
    high = rules.end[0] * 12 + rules.end[1]
    years = F.col("year").between(rules.start[0], rules.end[0])
    return years & month_index().between(low, high)


def label(df: DataFrame, rules: Rules) -> DataFrame:
    """Final types, ``delay_rate`` and ``target`` (strictly above the threshold)."""
    rate = F.col("arr_del15") / F.col("arr_flights")
    typed = df.withColumns({
        "year": F.col("year").cast("int"),
        "month": F.col("month").cast("int"),
        "carrier": F.col("carrier").cast("string"),
        "airport": F.col("airport").cast("string"),
        "delay_rate": rate,
    })
    above = F.col("delay_rate") > F.lit(float(rules.threshold))
    return typed.withColumn("target", above.cast("int"))


def prepare_rows(df: DataFrame, rules: Rules) -> DataFrame:
    """The row-wise part of the preparation: no gate, no action; also fits a stream."""
    clean = fill_outcome(drop_incomplete(coerce(df)), rules)
    return label(clean.where(F.col("arr_flights") > 0).where(in_period(rules)), rules)


def check(df: DataFrame, rules: Rules) -> None:
    """Raise on contradicting outcomes, on a month outside 1-12 and on an empty result.

    One aggregate over the raw table, separate from the filters: a contradicting row outside
    the period still fails the load.
    """
    rows = drop_incomplete(coerce(df))
    months = F.col("month").cast("int").between(1, 12)
    kept = (F.col("arr_flights") > 0) & in_period(rules)
    if rules.missing == "drop":
        kept = kept & F.col("arr_del15").isNotNull()
    found = rows.agg(
        F.count_if(is_conflict(rows)).alias("conflicts"),
        F.count_if(kept & ~months).alias("months"),
        F.count_if(kept).alias("kept"),
    ).first()
    if rules.missing == "zero" and found["conflicts"]:
        raise ValueError("A missing arr_del15 conflicts with delays reported in the same row.")
    if found["months"]:
        raise ValueError("Months outside 1-12.")
    if not found["kept"]:
        raise ValueError("No rows are left: all are incomplete, without flights or out of the period.")


def prepare(df: DataFrame, rules: Rules) -> DataFrame:
    """Checked, cleaned and labelled rows."""
    check(df, rules)
    return prepare_rows(df, rules)


def summarize(raw: DataFrame, rules: Rules) -> DataFrame:
    """Raw and valid row counts, positive rate and period: one row from one scan."""
    counts = coerce(raw)
    valid = F.col("arr_flights") > 0
    for name in ESSENTIAL:
        valid = valid & F.col(name).isNotNull()
    if rules.missing == "drop":
        valid = valid & F.col("arr_del15").isNotNull()
    valid = F.coalesce(valid & in_period(rules), F.lit(False))
    rate = F.coalesce("arr_del15", F.lit(0.0)) / F.col("arr_flights")
    target = F.when(valid, (rate > F.lit(float(rules.threshold))).cast("int"))
    return counts.withColumn("_valid", valid).withColumn("_target", target).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if("_valid").alias("valid_rows"),
        F.avg("_target").alias("positive_rate"),
        F.min(F.when(F.col("_valid"), month_index())).alias("_first"),
        F.max(F.when(F.col("_valid"), month_index())).alias("_last"),
    ).select(
        "raw_rows", "valid_rows", "positive_rate",
        _period("_first").alias("start_period"), _period("_last").alias("end_period"),
    )


def _period(index: str) -> Column:
    month = (F.col(index) - 1) % 12 + 1
    return period_text((F.col(index) - month) / 12, month)


def validation_report(summary: DataFrame, expected: dict[str, float]) -> DataFrame:
    """Observed against expected figures; only the expected keys, counts exact, rate 1e-4."""
    keys = [k for k in ("raw_rows", "valid_rows", "positive_rate") if k in expected]
    rows = [
        F.struct(
            F.lit(k).alias("key"),
            F.col(k).cast("double").alias("observed"),
            F.lit(float(expected[k])).alias("expected"),
            F.lit(1e-4 if k == "positive_rate" else 0.0).alias("tolerance"),
        )
        for k in keys
    ]
    return summary.select(F.explode(F.array(*rows)).alias("r")).select(
        "r.key", "r.observed", "r.expected",
        (F.abs(F.col("r.observed") - F.col("r.expected")) <= F.col("r.tolerance"))
        .alias("matches"),
    )


def feature_frame(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The five features and the target, plus key columns; outcome columns are refused."""
    require_columns(df, FEATURES + ["target"])
    keep = list(keep or [])
    leaked = sorted((set(keep) | set(FEATURES)) & set(OUTCOMES))
    if leaked:
        raise ValueError(f"Outcome columns may not become features: {leaked}")
    return df.select(*keep, *FEATURES, F.col("target").cast("int").alias("target"))


def class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("rows"))


def split_summary(df: DataFrame) -> DataFrame:
    """Rows per part and class, before and after balancing."""
    return df.groupBy("part", "target").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("kept_rows")
    )


def decide(probability: str, threshold: float = 0.5) -> Column:
    """Hard class: at or above the threshold."""
    return (F.col(probability) >= F.lit(float(threshold))).cast("int")
