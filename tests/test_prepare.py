import pytest
from pyspark.sql import functions as F

from punctua.operators import prepare
from punctua.operators.prepare import Rules
from punctua.streaming import label_stream

SCHEMA = "year int, month int, carrier string, airport string, arr_flights double, arr_del15 double"


def unit(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_strict_target_and_summary(spark):
    raw = unit(spark, [(2024, 1, "AA", "ATL", 100.0, 20.0), (2024, 1, "AA", "ATL", 100.0, 21.0),
                       (2024, 1, "AA", "ATL", 0.0, 0.0)])
    rows = prepare.prepare(raw, Rules()).orderBy("arr_del15").collect()
    assert [(r.target, r.delay_rate) for r in rows] == [(0, 0.20), (1, 0.21)]
    summary = prepare.summarize(raw, Rules())
    assert tuple(summary.first()) == (3, 2, 0.5, "2024-01", "2024-01")
    report = prepare.validation_report(summary, {"raw_rows": 3, "positive_rate": 0.4999})
    assert {r.key: r.matches for r in report.collect()} == {"raw_rows": True,
                                                            "positive_rate": True}


def test_missing_outcome_policies(spark):
    raw = unit(spark, [(2024, 1, "AA", "ATL", 10.0, None), (2024, 1, "AA", "ATL", 10.0, 3.0)])
    zero = prepare.prepare(raw, Rules()).orderBy("arr_del15").collect()
    assert [(r.arr_del15, r.target) for r in zero] == [(0.0, 0), (3.0, 1)]
    assert prepare.prepare(raw, Rules(missing="drop")).count() == 1


def test_conflict_fails_even_outside_the_period(spark):
    raw = unit(spark, [(1999, 1, "AA", "ATL", 10.0, None, "15"),
                       (2024, 1, "AA", "ATL", 10.0, 1.0, "0")], SCHEMA + ", arr_delay string")
    with pytest.raises(ValueError, match="conflicts"):
        prepare.prepare(raw, Rules())
    assert prepare.conflicts(prepare.drop_incomplete(prepare.coerce(raw))).count() == 1


def test_gates(spark):
    with pytest.raises(ValueError, match="airport"):
        prepare.coerce(spark.createDataFrame([(1,)], "year int"))
    with pytest.raises(ValueError, match="Months"):
        prepare.prepare(unit(spark, [(2024, 13, "AA", "ATL", 1.0, 0.0)]), Rules())
    with pytest.raises(ValueError, match="No rows"):
        prepare.prepare(unit(spark, [(1990, 1, "AA", "ATL", 1.0, 0.0)]), Rules())
    leaky = unit(spark, [(2024, 1, "AA", "ATL", 1.0, 0.0)]).withColumn("target", F.lit(1))
    with pytest.raises(ValueError, match="Outcome"):
        prepare.feature_frame(leaky, ["arr_del15"])
    assert prepare.feature_frame(leaky).columns == [*prepare.FEATURES, "target"]


def test_numbers_from_text(spark):
    texts = ["12", " 1e1 ", "12d", "x", "nan", "inf", "1e999", "-3.5", None]
    raw = spark.createDataFrame([(2024, 1, "AA", "ATL", t, "0") for t in texts],
                                "year int, month int, carrier string, airport string, "
                                "arr_flights string, arr_del15 string")
    got = [r.arr_flights for r in prepare.coerce(raw).collect()]
    assert sorted(got, key=str) == sorted([12.0, 10.0, -3.5] + [None] * 6, key=str)


def test_labelling_runs_on_a_stream(spark, tmp_path):
    rows = unit(spark, [(2024, 1, "AA", "ATL", 10.0, 3.0), (2024, 1, "AA", "ATL", 10.0, None)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    job = label_stream(stream, Rules()).writeStream.format("memory").queryName("labels").start()
    job.processAllAvailable()
    job.stop()
    assert sorted(r.target for r in spark.table("labels").collect()) == [0, 1]
