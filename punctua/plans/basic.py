"""Registered queries: sources, cleaning, aggregates, splits, features."""

from __future__ import annotations

import sys
import zipfile

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctua.operators import features, order, prepare, split
from punctua.plans import units as u
from punctua.plans.oracle import DAMAGED, PREPARED, SPLIT, UNITS, h, quota, w
from punctua.plans.registry import query
from punctua.session import work_path
from punctua.sources import load_raw, manifest


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its task functions travel


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def _export(df: DataFrame, path: str, folders: list[str] | None = None) -> None:
    writer = df.write.mode("errorifexists").option("header", True)
    (writer.partitionBy(*folders) if folders else writer).csv(path)


ALL6 = "year, month, carrier, airport, arr_flights, arr_del15"


# -- sources ---------------------------------------------------------------------------------

@query("s2_csv_scan", w(UNITS, f"select unit_id, {ALL6} from units"))
def s2(spark, sf):
    path = work_path(spark, "export")
    _export(u.units(spark, sf), path)
    raw = load_raw(spark, path)
    return raw.select(
        F.col("unit_id").cast("bigint").alias("unit_id"), F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"), "carrier", "airport",
        F.col("arr_flights").cast("double").alias("arr_flights"),
        F.col("arr_del15").cast("double").alias("arr_del15"),
    )


@query("s4_concat_by_name", w(UNITS, """
select cast(year as varchar) as year, carrier, case when unit_id % 2 = 0 then airport end
  as airport, cast(unit_id as varchar) as unit_id from units"""))
def s4(spark, sf):
    path = work_path(spark, "exports")
    rows = u.units(spark, sf)
    even = rows.where(F.col("unit_id") % 2 == 0)
    odd = rows.where(F.col("unit_id") % 2 == 1)
    _export(even.select(F.col("year").alias("Year "), "carrier", "airport", "unit_id"),
            path + "/a")
    _export(odd.select("unit_id", F.col("carrier").alias("Carrier"), "year"), path + "/b")
    return load_raw(spark, path).select("year", "carrier", "airport", "unit_id")


@query("s5_na_tokens", w(UNITS, """
select cast(unit_id as varchar) as unit_id,
  case when unit_id % 5 > 2 then carrier end as carrier from units"""))
def s5(spark, sf):
    path = work_path(spark, "na")
    uid = F.col("unit_id") % 5
    text = F.when(uid == 0, "NA").when(uid == 1, "n/a").when(uid == 2, "NULL")
    _export(u.units(spark, sf).select("unit_id", text.otherwise(F.col("carrier"))
                                      .alias("carrier")), path)
    return load_raw(spark, path)


# One export file per carrier, its rows in the order of their ids.
@query("s9_manifest", w(UNITS + """,
files as (select carrier, 'unit_id,year,airport' || chr(10) || string_agg(
    unit_id || ',' || year || ',' || airport, chr(10) order by unit_id) || chr(10) as content
  from units group by carrier)""", """
select strlen(content) as bytes, sha256(content) as sha256 from files"""))
def s9(spark, sf):
    path = work_path(spark, "export")
    rows = u.units(spark, sf).select("unit_id", "year", "airport", "carrier")
    _export(rows.repartition("carrier").sortWithinPartitions("carrier", "unit_id"), path, ["carrier"])
    return manifest(spark, path).where(F.col("file").endswith(".csv")).select("bytes", "sha256")


def _archive(carrier: str, rows: list[tuple], path: str) -> None:
    """One archive with two members whose headers differ."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    inside = f"{inside}/{carrier}.zip"
    with system.open_output_stream(inside) as raw, zipfile.ZipFile(
            raw, "w", zipfile.ZIP_DEFLATED) as archive:
        for part, header in enumerate(("Unit ID,year,airport", "airport,Unit ID")):
            lines = [header] + [f"{i},{y},{a}" if part == 0 else f"{a},{i}"
                                for i, y, a in rows if i % 2 == part]
            archive.writestr(f"part{part}.csv", "\n".join(lines) + "\n")


@query("s3_zip_scan", w(UNITS, """
select cast(unit_id as varchar) as unit_id,
  case when unit_id % 2 = 0 then cast(year as varchar) end as year, airport from units"""))
def s3(spark, sf):
    path = work_path(spark, "archives")
    rows = u.units(spark, sf).select("unit_id", "year", "airport", "carrier")
    spark.createDataFrame([(1,)], "a int").write.parquet(path)  # makes the folder

    def write(key, table):
        columns = [table.column(c).to_pylist() for c in ("unit_id", "year", "airport")]
        _archive(key[0].as_py(), list(zip(*columns)), path)
        return pa.table({"rows": pa.array([table.num_rows], pa.int64())})

    rows.groupBy("carrier").applyInArrow(write, "rows long").agg(F.sum("rows")).collect()
    return load_raw(spark, path)


# -- cleaning --------------------------------------------------------------------------------

@query("t2_coerce", w(DAMAGED, f"select unit_id, {ALL6} from coerced"))
def t2(spark, sf):
    return prepare.coerce(u.damaged(spark, sf)).select("unit_id", *prepare.REQUIRED)


@query("t3_drop_incomplete", w(DAMAGED, f"select unit_id, {ALL6} from complete"))
def t3(spark, sf):
    rows = prepare.drop_incomplete(prepare.coerce(u.damaged(spark, sf)))
    return rows.select("unit_id", *prepare.REQUIRED)


@query("t4_missing_zero", w(DAMAGED, """
select unit_id, coalesce(arr_del15, 0::double) as arr_del15 from complete"""))
def t4(spark, sf):
    rows = prepare.drop_incomplete(prepare.coerce(u.damaged(spark, sf)))
    return prepare.fill_outcome(rows, u.RULES).select("unit_id", "arr_del15")


@query("t5_missing_drop", w(DAMAGED, """
select unit_id, arr_del15 from complete where arr_del15 is not null"""))
def t5(spark, sf):
    rows = prepare.drop_incomplete(prepare.coerce(u.damaged(spark, sf)))
    rules = prepare.Rules(missing="drop", start=u.RULES.start, end=u.RULES.end)
    return prepare.fill_outcome(rows, rules).select("unit_id", "arr_del15")


@query("t6_conflict_evidence", w(DAMAGED, """
select unit_id, year, month, carrier, airport from complete
where arr_del15 is null and try_cast(arr_delay as double) > 0"""))
def t6(spark, sf):
    rows = prepare.drop_incomplete(prepare.coerce(u.damaged(spark, sf)))
    return prepare.conflicts(rows).select("unit_id", "year", "month", "carrier", "airport")


@query("t7_positive_flights", w(DAMAGED, """
select unit_id, arr_flights from complete where arr_flights > 0"""))
def t7(spark, sf):
    rows = prepare.drop_incomplete(prepare.coerce(u.damaged(spark, sf)))
    return rows.where(F.col("arr_flights") > 0).select("unit_id", "arr_flights")


@query("t8_month_range", w(UNITS, """
select unit_id, year, month from units where year * 12 + month between 23964 and 23989"""))
def t8(spark, sf):
    rules = prepare.Rules(start=(1996, 12), end=(1999, 1))
    return u.units(spark, sf).where(prepare.in_period(rules)).select("unit_id", "year", "month")


@query("t10_prepared_rows", w(DAMAGED, "select * from cleaned"))
def t10(spark, sf):
    return prepare.prepare_rows(u.damaged(spark, sf), u.RULES).drop("arr_delay")


@query("t11_delay_rate", w(PREPARED, "select unit_id, round(delay_rate, 9) as rate from prepared"))
def t11(spark, sf):
    return u.labelled(spark, sf).select("unit_id", F.round("delay_rate", 9).alias("rate"))


@query("t12_target", w(PREPARED, "select unit_id, target from prepared"))
def t12(spark, sf):
    return u.labelled(spark, sf).select("unit_id", "target")


@query("t12_target_events", """
with e as (select cast(ts as date) as day, event_type, user_id % 50 as grp,
    cast(count(*) as double) as n, cast(sum(case when value > 80 then 1 else 0 end) as double) as d
  from events group by cast(ts as date), event_type, user_id % 50)
select cast(day as varchar) as day, event_type, grp, n as arr_flights, d as arr_del15,
  cast(d / n > 0.2::double as int) as target from e""")
def t12_events(spark, sf):
    rows = u.event_units(spark, sf)
    rate = F.col("arr_del15") / F.col("arr_flights")
    return rows.select(F.col("day").cast("string").alias("day"), "event_type", "grp",
                       "arr_flights", "arr_del15", (rate > F.lit(0.2)).cast("int").alias("target"))


@query("t13_features", w(PREPARED, """
select unit_id, year, month, carrier, airport, arr_flights, target from prepared"""))
def t13(spark, sf):
    return prepare.feature_frame(u.labelled(spark, sf), ["unit_id"])


# -- aggregates ------------------------------------------------------------------------------

@query("a1_dataset_summary", w(DAMAGED, """
select (select count(*) from damaged) as raw_rows, count(*) as valid_rows,
  round(avg(target), 6) as positive_rate,
  min(year || '-' || lpad(cast(month as varchar), 2, '0')) as start_period,
  max(year || '-' || lpad(cast(month as varchar), 2, '0')) as end_period from cleaned"""))
def a1(spark, sf):
    summary = prepare.summarize(u.damaged(spark, sf), u.RULES)
    return summary.select("raw_rows", "valid_rows", *r6("positive_rate"), "start_period",
                          "end_period")


@query("a2_class_counts", w(PREPARED, """
select target, count(*) as rows from prepared group by target"""))
def a2(spark, sf):
    return prepare.class_counts(u.labelled(spark, sf))


@query("a2_class_counts_labels", "select quality, count(*) as rows from labels group by quality")
def a2_labels(spark, sf):
    return prepare.class_counts(u.table(spark, sf, "labels"), "quality")


EXPECTED = {"raw_rows": 10207, "valid_rows": 10006, "positive_rate": 0.6}


@query("a3_validation_report", w(DAMAGED, """
select key, round(observed, 6) as observed, expected, abs(observed - expected) <= tol as matches
from (select unnest([
  {'key': 'raw_rows', 'observed': (select count(*) from damaged)::double,
   'expected': 10207::double, 'tol': 0::double},
  {'key': 'valid_rows', 'observed': count(*)::double, 'expected': 10006::double,
   'tol': 0::double},
  {'key': 'positive_rate', 'observed': avg(target), 'expected': 0.6::double,
   'tol': 1e-4::double}], recursive := true) from cleaned)"""))
def a3(spark, sf):
    report = prepare.validation_report(
        prepare.summarize(u.damaged(spark, sf), u.RULES), EXPECTED
    )
    return report.select("key", *r6("observed"), "expected", "matches")


@query("a4_split_summary", w(SPLIT, """
select part, target, count(*) as rows, sum(case when kept then 1 else 0 end)::bigint as kept_rows
from parts group by part, target"""))
def a4(spark, sf):
    return prepare.split_summary(u.parts(spark, sf))


@query("a10_distinct_categories", w(UNITS, """
select carrier, count(distinct airport) as airports, count(distinct year) as years
from units group by carrier"""))
def a10(spark, sf):
    # Distinct (carrier, airport) and (carrier, year) pairs first, so a hot carrier is combined
    # on the map side.
    rows = u.units(spark, sf)
    airports = rows.select("carrier", "airport").distinct().groupBy("carrier").agg(
        F.count(F.lit(1)).alias("airports"))
    years = rows.select("carrier", "year").distinct().groupBy("carrier").agg(
        F.count(F.lit(1)).alias("years"))
    return airports.join(years, "carrier")


@query("a9_exact_quantiles", w(UNITS, """
select unnest([0.025::double, 0.25::double, 0.5::double, 0.975::double]) as prob,
  unnest([round(quantile_cont(arr_flights, 0.025), 6), round(quantile_cont(arr_flights, 0.25), 6),
          round(quantile_cont(arr_flights, 0.5), 6), round(quantile_cont(arr_flights, 0.975), 6)])
  as quantile from units"""))
def a9(spark, sf):
    found = order.quantiles(u.units(spark, sf), "arr_flights", [0.025, 0.25, 0.5, 0.975])
    return found.select("prob", *r6("quantile"))


# -- splits ----------------------------------------------------------------------------------

@query("d1_stratified_split", w(SPLIT, "select unit_id, target, part from parts"))
def d1(spark, sf):
    rows = split.random_split(u.labelled(spark, sf), 0.2, u.SPLIT_SEED, "unit_id")
    return rows.select("unit_id", "target", "part")


@query("d2_undersample", w(SPLIT, "select unit_id, target, part, kept from parts"))
def d2(spark, sf):
    return u.parts(spark, sf).select("unit_id", "target", "part", "kept")


@query("d2_undersample_labels", f"""
with n as (select min(c) as c from (select count(*) as c from labels group by quality))
select doc_id, quality, row_number() over (partition by quality
  order by {h('labels42', 'doc_id')}, doc_id) <= (select c from n) as kept from labels""")
def d2_labels(spark, sf):
    rows = u.table(spark, sf, "labels").select("doc_id", "quality")
    return split.undersample(rows, "labels42", "doc_id", "quality")


TEMPORAL = PREPARED + f""",
tparts0 as (select *, case when year <= 1999 then 'train' else 'test' end as part from prepared),
tsmall as (select min(c) as c from (select count(*) as c from tparts0 where part = 'train'
           group by target)),
tparts as (select *, part = 'test' or row_number() over (partition by part, target
             order by {h('under42')}, unit_id) <= (select c from tsmall) as kept from tparts0)"""


@query("d3_temporal_split", w(TEMPORAL, "select unit_id, year, target, part, kept from tparts"))
def d3(spark, sf):
    return u.temporal_parts(spark, sf).select("unit_id", "year", "target", "part", "kept")


def folds_sql(seed: str, k: int) -> str:
    return SPLIT + f""",
classes as (select target, sum(count(*)) over (order by target) - count(*) as off
            from train group by target),
folds as (select t.*, cast((off + row_number() over (partition by t.target
            order by {h(seed)}, unit_id) - 1) % {k} as int) as fold
          from train t join classes using (target))"""


FOLDS = folds_sql("fold42", 5)


@query("d4_stratified_folds", w(FOLDS, "select unit_id, target, fold from folds"))
def d4(spark, sf):
    train = u.train_of(u.parts(spark, sf))
    return split.stratified_folds(train, 5, "fold42", "unit_id").select(
        "unit_id", "target", "fold")


@query("w4_fold_sizes", w(FOLDS, """
select fold, target, count(*) as rows from folds group by fold, target"""))
def w4(spark, sf):
    return d4(spark, sf).groupBy("fold", "target").agg(F.count(F.lit(1)).alias("rows"))


@query("d5_stratified_subsample", w(SPLIT + "," + quota("train", "1201::bigint", "q5") + f""",
ranked as (select t.*, row_number() over (partition by t.target
             order by {h('sample42')}, unit_id) as r from train t)""", """
select unit_id, target from ranked join q5 using (target)
where r <= k or (select count(*) from train) <= 1201"""))
def d5(spark, sf):
    train = u.train_of(u.parts(spark, sf))
    return split.subsample(train, 1201, "sample42", "unit_id").select("unit_id", "target")


@query("d6_early_stop_holdout", w(
    SPLIT + "," + quota("train", "cast(ceil(count(*) * cast(0.1 as double)) as bigint)", "q6"),
    f"""select unit_id, target, row_number() over (partition by t.target
          order by {h('stop42')}, unit_id) <= k as is_validation
        from train t join q6 using (target)"""))
def d6(spark, sf):
    train = u.train_of(u.parts(spark, sf))
    return split.holdout(train, "stop42", "unit_id").select("unit_id", "target", "is_validation")


@query("d8_random_subset", w(UNITS, f"""
select unit_id from units qualify row_number() over (order by {h('mand42')}, unit_id)
  <= floor((select count(*) from units) * cast(0.05 as double))"""))
def d8(spark, sf):
    rows = split.draw(u.units(spark, sf), "mand42", "unit_id", fraction=0.05)
    return rows.where("drawn").select("unit_id")


# -- features --------------------------------------------------------------------------------

def code_cte(column: str) -> str:
    return f"""
{column}_codes as (select {column}, count(*) as rows,
    row_number() over (order by {column}) - 1 as code from train group by {column})"""


ORDINAL = SPLIT + "," + code_cte("carrier") + "," + code_cte("airport") + """,
meds as (select median(year) as my, median(month) as mm, median(arr_flights) as mf from train),
encoded as (select p.unit_id, p.part, p.kept, p.target,
    cast(coalesce(c.code, -1) as double) as x_carrier,
    cast(coalesce(a.code, -1) as double) as x_airport, cast(year as double) as x_year,
    cast(month as double) as x_month, arr_flights as x_arr_flights
  from parts p left join carrier_codes c using (carrier) left join airport_codes a using (airport))
"""

XS = "x_carrier, x_airport, x_year, x_month, x_arr_flights"


@query("f1_ordinal_codes", w(ORDINAL, f"select unit_id, {XS} from encoded"))
def f1(spark, sf):
    rows = u.parts(spark, sf)
    encoding = features.fit_ordinal(u.train_of(rows))
    return encoding.transform(rows).select("unit_id", *features.ORDINAL)


@query("j4_unknown_category", w(SPLIT + """,
known as (select airport, count(*) as n, row_number() over (order by airport) - 1 as code
          from train where airport < 'M' group by airport)""", """
select unit_id, airport, coalesce(code, -1) as code from parts left join known using (airport)"""))
def j4(spark, sf):
    rows = u.parts(spark, sf)
    seen = u.train_of(rows).where(F.col("airport") < "M")
    codes = features.category_codes(seen, "airport").select("airport", "code")
    return rows.join(codes, "airport", "left").select(
        "unit_id", "airport", F.coalesce("code", F.lit(-1)).alias("code"))


@query("f2_medians", w(SPLIT, """
select 'year' as name, median(year)::double as med from train
union all select 'month', median(month)::double from train
union all select 'arr_flights', median(arr_flights)::double from train"""))
def f2(spark, sf):
    train = u.train_of(u.parts(spark, sf))
    found = features.medians(train, prepare.NUMERIC)
    return spark.createDataFrame(list(found.items()), "name string, med double")


@query("f3_one_hot", w(SPLIT + """,
cats as (select key, count(*) as n from
         (select carrier || ' ' || cast(year as varchar) || ' ' || airport as key from train)
         group by key),
slots as (select key, row_number() over (order by key) - 1 as slot from cats where n >= 2
          union all select key, (select count(*) from cats where n >= 2) from cats where n < 2)""",
    """select unit_id, slot from test
       join slots on key = carrier || ' ' || cast(year as varchar) || ' ' || airport"""))
def f3(spark, sf):
    key = F.concat_ws(" ", "carrier", F.col("year").cast("string"), "airport")
    rows = u.parts(spark, sf).withColumn("key", key)
    codes = features.category_codes(u.train_of(rows), "key")
    slots = {"key": features.category_slots(codes, "key")}
    return features.one_hot_long(u.test_of(rows), slots, "unit_id").select("unit_id", "slot")


@query("f3_one_hot_categories", w(SPLIT + "," + code_cte("carrier") + "," + code_cte("airport"), """
select unit_id, 'carrier' as feature, code as slot from test join carrier_codes using (carrier)
union all
select unit_id, 'airport' as feature, code as slot from test join airport_codes using (airport)
"""))
def f3_categories(spark, sf):
    rows = u.parts(spark, sf)
    train = u.train_of(rows)
    slots = {c: features.category_slots(features.category_codes(train, c), c)
             for c in prepare.CATEGORICAL}
    return features.one_hot_long(u.test_of(rows), slots, "unit_id")


SCALED_SQL = ORDINAL + ",\nstats as (select " + ", ".join(
    f"avg(x_{c}) as m_{c}, stddev_pop(x_{c}) as s_{c}"
    for c in prepare.CATEGORICAL + prepare.NUMERIC
) + """ from encoded where part = 'train' and kept),
scaled as (select encoded.*, """ + ", ".join(
    f"(x_{c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end as z_{c}"
    for c in prepare.CATEGORICAL + prepare.NUMERIC
) + " from encoded, stats)"


@query("f4_scaled", w(SCALED_SQL, "select unit_id, " + ", ".join(
    f"round({c}, 6) as {c}" for c in features.SCALED) + " from scaled"))
def f4(spark, sf):
    rows = u.parts(spark, sf)
    encoding = features.fit_ordinal(u.train_of(rows), scaled=True)
    return encoding.transform(rows).select("unit_id", *r6(*features.SCALED))


# Every category of the given tables has two training rows or more, so its slot is its code.
F5 = SCALED_SQL + """,
widths as (select (select count(*) from carrier_codes) as wc,
                  (select count(*) from airport_codes) as wa),
hot as (select unit_id, code as slot, 1::double as value
        from test join carrier_codes using (carrier)
  union all select unit_id, wc + code, 1::double from test join airport_codes using (airport), widths
""" + "".join(f"  union all select unit_id, wc + wa + {k}, z_{c} from scaled, widths where part = 'test'\n"
              for k, c in enumerate(prepare.NUMERIC)) + ")"


@query("f5_one_hot_vectors", w(F5, """
select unit_id, slot, round(value, 6) as value from hot where value <> 0"""))
def f5(spark, sf):
    rows = u.parts(spark, sf)
    encoding = features.fit_one_hot(u.train_of(rows))
    found = encoding.transform(u.test_of(rows)).select(
        "unit_id", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return found.where("value <> 0").select(
        "unit_id", F.col("slot").cast("bigint").alias("slot"), *r6("value"))
