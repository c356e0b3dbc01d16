"""Registered queries: evaluation, ranking, selection and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from punctua.operators import evaluate, integrity, order, prepare, selection
from punctua.plans import units as u
from punctua.plans.basic import r6
from punctua.plans.oracle import SCORED, SPLIT, decision, h, metrics, w
from punctua.plans.registry import query

# -- evaluation ------------------------------------------------------------------------------

# Two score columns per test unit: the prior rate, and the rate of the carrier alone.
MODELS_SQL = SCORED + """,
rate2 as (select airport, (sum(target) + 1.0::double) / (count(*) + 2.0::double) as r
          from train group by airport),
models as (select unit_id, 'prior' as model, probability, target from scored
           union all
           select unit_id, 'airport_rate', coalesce(r, 0.5::double), target
           from test left join rate2 using (airport))"""


def model_scores(spark, sf):
    """Long scores of two reference models (unit_id, model, probability, target)."""
    rows = u.parts(spark, sf)
    rate = u.settle(u.train_of(rows).groupBy("airport").agg(
        ((F.sum("target") + F.lit(1.0)) / (F.count(F.lit(1)) + F.lit(2.0))).alias("_r")))
    second = u.test_of(rows).join(rate, "airport", "left").select(
        "unit_id", F.lit("airport_rate").alias("model"),
        F.coalesce("_r", F.lit(0.5)).alias("probability"), "target")
    first = u.prior_scores(rows).select(
        "unit_id", F.lit("prior").alias("model"), "probability", "target")
    return u.stage(first.unionByName(second), "scores")


def _metric(column):
    def run(spark, sf):
        table = evaluate.metrics(model_scores(spark, sf), ["model"])
        return table.select("model", *r6(column))

    return run


for _name, _column in (("e1_roc_auc", "roc_auc"), ("e2_average_precision", "pr_auc"),
                       ("e3_f1", "f1"), ("e4_brier", "brier"), ("e5_accuracy", "accuracy")):
    query(_name, w(MODELS_SQL + "," + metrics("models"),
                   f"select model, {_column} from metrics"))(_metric(_column))


@query("e6_precision_recall", w(MODELS_SQL + "," + metrics("models"),
                                "select model, precision, recall from metrics"))
def e6(spark, sf):
    table = evaluate.metrics(model_scores(spark, sf), ["model"])
    return table.select("model", *r6("precision", "recall"))


@query("e7_metric_table", w(MODELS_SQL + "," + metrics("models"), "select * from metrics"))
def e7(spark, sf):
    table = evaluate.metrics(model_scores(spark, sf), ["model"])
    return table.select("model", *r6(*evaluate.METRICS)).orderBy(F.desc("roc_auc"))


@query("w5_metric_order", w(MODELS_SQL + "," + metrics("models"), """
select model, roc_auc, row_number() over (order by roc_auc desc, model) as place from metrics"""))
def w5(spark, sf):
    table = evaluate.metrics(model_scores(spark, sf), ["model"]).select("model", *r6("roc_auc"))
    # One row per model.
    place = F.row_number().over(W.orderBy(F.desc("roc_auc"), "model"))
    return table.withColumn("place", place.cast("bigint")).orderBy("place")


@query("a8_confusion", w(MODELS_SQL, """
select model, sum(case when probability >= 0.5 and target = 1 then 1 else 0 end)::bigint as tp,
  sum(case when probability >= 0.5 and target = 0 then 1 else 0 end)::bigint as fp,
  sum(case when probability < 0.5 and target = 1 then 1 else 0 end)::bigint as fn,
  sum(case when probability < 0.5 and target = 0 then 1 else 0 end)::bigint as tn
from models group by model"""))
def a8(spark, sf):
    return evaluate.confusion(model_scores(spark, sf), ["model"])


@query("t14_hard_decision", w(SCORED, """
select unit_id, cast(probability >= 0.5 as int) as decision from scored"""))
def t14(spark, sf):
    return u.scored(spark, sf).select("unit_id", prepare.decide("probability").alias("decision"))


@query("w3_cumulative_curve", w(MODELS_SQL, """
select model, round(p, 9) as p, pos, neg, sum(pos) over win as cum_pos, sum(neg) over win as cum_neg
from (select model, probability as p, sum(target)::bigint as pos, sum(1 - target)::bigint as neg
      from models group by model, probability)
window win as (partition by model order by p desc)"""))
def w3(spark, sf):
    rows = evaluate.curve(model_scores(spark, sf), ["model"])
    return rows.select("model", F.round("p", 9).alias("p"), "pos", "neg", "cum_pos", "cum_neg")


def boot_sql(samples: int) -> str:
    draw = h("boot42", "r || '|' || (pos - 1)")
    return SCORED + f""",
numbered as (select *, row_number() over (order by probability, target desc) as pos from scored),
size as (select count(*) as n from numbered),
draws as (select r as replicate, {draw} % (select n from size) + 1 as pos
          from numbered, (select unnest(range({samples})) as r)),
boot as (select replicate, probability, target from draws join numbered using (pos)),
""" + metrics("boot", "replicate").lstrip()


@query("d7_bootstrap_replicates", w(boot_sql(20), "select * from metrics"))
def d7(spark, sf):
    table = evaluate.bootstrap(u.scored(spark, sf), "unit_id", 20, "boot42")
    return table.select(F.col("replicate").cast("bigint").alias("replicate"),
                        *r6(*evaluate.METRICS))


_E8 = " union all ".join(f"""select '{m}' as metric, round((select {m} from points), 6) as point,
  round(quantile_cont({m}, 0.025), 4) as ci_low, round(quantile_cont({m}, 0.975), 4) as ci_high,
  cast(count(*) as int) as bootstrap_samples from metrics""" for m in evaluate.METRICS)
POINTS = metrics("(select 'all' as model, * from scored)").replace("metrics as", "points as").replace(
    "cells", "pcells").replace("runs", "pruns").replace("sums", "psums").lstrip()


@query("e8_bootstrap_intervals", w(boot_sql(100) + ",\n" + POINTS, _E8))
def e8(spark, sf):
    table = evaluate.bootstrap_intervals(u.scored(spark, sf), "unit_id", 100, "boot42")
    return table.select("metric", *r6("point"), F.round("ci_low", 4).alias("ci_low"),
                        F.round("ci_high", 4).alias("ci_high"), "bootstrap_samples")


_EDGES = ", ".join(f"quantile_cont(probability, {i / 10})" for i in range(1, 10))


@query("e9_calibration", w(SCORED + f""",
edges as (select [{_EDGES}] as e from scored),
binned as (select cast(len(list_filter(e, lambda x: x < probability)) as int) as bin, probability, target
           from scored, edges)""", """
select bin, round(avg(probability), 6) as mean_predicted, round(avg(target), 6) as observed_rate,
  count(*) as rows from binned group by bin"""))
def e9(spark, sf):
    table = evaluate.calibration(u.scored(spark, sf), 10)
    return table.select("bin", *r6("mean_predicted", "observed_rate"), "rows")


@query("j2_wide_probabilities", w(MODELS_SQL, """
select unit_id, year, month, carrier, airport, arr_flights, target,
  round(max(case when model = 'prior' then probability end), 9) as probability_prior,
  round(max(case when model = 'airport_rate' then probability end), 9)
    as probability_airport_rate
from test join (select unit_id, model, probability from models) using (unit_id) group by all"""))
def j2(spark, sf):
    names = ["prior", "airport_rate"]
    wide = model_scores(spark, sf).groupBy("unit_id").pivot("model", names).agg(
        F.first("probability")).toDF("unit_id", *[f"probability_{n}" for n in names])
    rows = prepare.feature_frame(u.test_of(u.parts(spark, sf)), ["unit_id"])
    return rows.join(wide, "unit_id").withColumns(
        {f"probability_{n}": F.round(f"probability_{n}", 9) for n in names})


@query("j1_refetch_rows", w(SCORED, """
select p.* exclude (part, kept, target, delay_rate), p.target, round(p.delay_rate, 9) as delay_rate
from parts p join (select unit_id from scored where probability >= 0.5) using (unit_id)"""))
def j1(spark, sf):
    wanted = u.scored(spark, sf).where(F.col("probability") >= 0.5).select("unit_id")
    rows = u.labelled(spark, sf).join(wanted, "unit_id")
    return rows.withColumn("delay_rate", F.round("delay_rate", 9))


# -- selection -------------------------------------------------------------------------------

NET = SCORED + """,
net as (select *, value - 2000 * probability as net from scored),
cap as (select cast(floor(count(*) * 0.6::double) as bigint) as k from scored)"""


@query("o1_commercial_values", w(SCORED, "select unit_id, value from scored"))
def o1(spark, sf):
    rows = u.test_of(u.parts(spark, sf)).select("unit_id")
    return selection.commercial_values(rows, 1000, 5000, u.VALUE_SEED)


@query("o2_capacity_counts", w(SPLIT, """
select carrier, count(*) as n, cast(floor(count(*) * 0.6::double) as bigint) as cap
from test group by carrier"""))
def o2(spark, sf):
    rows = u.test_of(u.parts(spark, sf)).groupBy("carrier").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("cap", F.floor(F.col("n") * F.lit(u.CAPACITY)).cast("bigint"))


@query("t15_net_score", w(NET, """
select unit_id, round(net, 6) as net, round(value - 2000 * target, 6) as label_net from net"""))
def t15(spark, sf):
    return u.scored(spark, sf).select(
        "unit_id", F.round(selection.net_score(u.PENALTY), 6).alias("net"),
        F.round(selection.net_score(u.PENALTY, "target"), 6).alias("label_net"))


@query("w1_rank_selection", w(SCORED + """,
cap as (select cast(floor(count(*) * 0.6::double) as bigint) as k from scored)""", """
select unit_id,
  row_number() over (order by probability desc, unit_id desc) <= (select k from cap) as high,
  row_number() over (order by probability, unit_id) <= (select k from cap) as low from scored"""))
def w1(spark, sf):
    rows = u.scored(spark, sf)
    n = rows.count()
    quota = u.small_table(
        spark, [(n, selection.capacity_count(n, u.CAPACITY))], "n bigint, k bigint")
    high = order.top_k(rows, "probability", "unit_id", quota, out="high")
    both = order.top_k(high, "probability", "unit_id", quota, ascending=True, out="low")
    return both.select("unit_id", "high", "low")


@query("w2_rank_within_group", w(NET, """
select unit_id, carrier, row_number() over (partition by carrier order by net desc, unit_id desc)
  as rank from net"""))
def w2(spark, sf):
    rows = u.scored(spark, sf).withColumn("net", selection.net_score(u.PENALTY))
    ranked = order.rank_all(rows, "net", "unit_id", ["carrier"], ascending=False)
    return ranked.select("unit_id", "carrier", "rank")


FIVE = NET + f""",
ranked as (select *, row_number() over (order by {h('random42')}, unit_id) as r_random,
  row_number() over (order by value desc, unit_id desc) as r_value_only,
  row_number() over (order by probability, unit_id) as r_risk_only,
  row_number() over (order by net desc, unit_id desc) as r_net_score,
  row_number() over (order by value - 2000 * target desc, unit_id desc) as r_binary_label_policy
  from net),
five as (""" + " union all ".join(f"""select unit_id, carrier, airport, target, value, probability,
  '{p}' as strategy, r_{p} <= (select k from cap) as selected from ranked"""
                                  for p in selection.POLICIES) + ")"

STRUCT = f""",
forced as (select *, row_number() over (order by {h('mand42')}, unit_id)
  <= floor((select count(*) from net) * 0.05::double) as mandatory from net),
lows as (select carrier, greatest(cast(ceil(count(*) * 0.4::double) as bigint)
  - sum(case when mandatory then 1 else 0 end), 0) as low from forced group by carrier),
own as (select f.*, not mandatory and row_number() over (partition by carrier, mandatory
  order by net desc, unit_id desc) <= low as picked from forced f join lows using (carrier)),
room as (select (select k from cap) - sum(case when mandatory or picked then 1 else 0 end) as k
         from own),
fill as (select *, mandatory or picked or (net > 0 and row_number() over
  (partition by mandatory or picked order by net desc, unit_id desc) <= (select k from room))
  as selected from own)"""

SEVEN = FIVE + STRUCT + """,
seven as (select * from five
  union all select unit_id, carrier, airport, target, value, probability, 'capacity_only_milp',
    net > 0 and r_net_score <= (select k from cap) from ranked
  union all select unit_id, carrier, airport, target, value, probability, 'structural_milp',
    selected from fill)"""


@query("o3_five_policies", w(FIVE, "select unit_id, strategy, selected from five"))
def o3(spark, sf):
    marked = selection.policies(u.scored(spark, sf), u.PENALTY, u.CAPACITY, u.RANDOM_SEED)
    return marked.select("unit_id", "strategy", "selected")


@query("o4_capacity_optimum", w(SEVEN, """
select unit_id, selected from seven where strategy = 'capacity_only_milp'"""))
def o4(spark, sf):
    marked = selection.capacity_optimum(u.scored(spark, sf), u.PENALTY, u.CAPACITY)
    return marked.select("unit_id", "selected")


@query("o4_negative_net", w(SCORED, """
select unit_id, value - 6000 * probability > 0
  and row_number() over (order by value - 6000 * probability desc, unit_id desc)
  <= floor((select count(*) from scored) * 0.9::double) as selected from scored"""))
def o4_negative(spark, sf):
    marked = selection.capacity_optimum(u.scored(spark, sf), 6000.0, 0.9)
    return marked.select("unit_id", "selected")


@query("o5_mandatory_units", w(NET + STRUCT, "select unit_id, mandatory from forced"))
def o5(spark, sf):
    rows = selection.mandatory_units(u.scored(spark, sf), u.MANDATORY_FRACTION, u.MANDATORY_SEED)
    return rows.select("unit_id", "mandatory")


@query("o6_group_minimum", w(NET + STRUCT, "select unit_id, carrier, mandatory, selected from fill"))
def o6(spark, sf):
    rows = selection.mandatory_units(u.scored(spark, sf), u.MANDATORY_FRACTION, u.MANDATORY_SEED)
    marked = selection.structural_optimum(rows, u.PENALTY, u.CAPACITY, "carrier",
                                          u.GROUP_FRACTION)
    return marked.select("unit_id", "carrier", "mandatory", "selected")


def _compared(spark, sf):
    return u.stage(selection.compare(
        u.scored(spark, sf), u.PENALTY, u.CAPACITY, u.RANDOM_SEED, "carrier", u.GROUP_FRACTION,
        u.MANDATORY_FRACTION, u.MANDATORY_SEED), "marked")


def _money(table, keys):
    return table.select(
        *keys, *[F.round(c, 4).alias(c)
                 for c in ("total_cost", "commercial_loss", "expected_penalty")],
        *r6("risk_sum", "average_probability"), "operated")


@query("o7_decision_metrics", w(FIVE, decision("five")))
def o7(spark, sf):
    marked = selection.policies(u.scored(spark, sf), u.PENALTY, u.CAPACITY, u.RANDOM_SEED)
    return _money(selection.decision_metrics(marked, u.PENALTY), ["strategy"])


@query("a7_decisions_by_carrier", w(FIVE + """,
keyed as (select *, strategy || '/' || carrier as cell from five)""", decision("keyed", "cell")))
def a7(spark, sf):
    marked = selection.policies(u.scored(spark, sf), u.PENALTY, u.CAPACITY, u.RANDOM_SEED)
    keyed = marked.withColumn("cell", F.concat_ws("/", "strategy", "carrier"))
    return _money(selection.decision_metrics(keyed, u.PENALTY, ["cell"]), ["cell"])


_O10 = f"""select *, case when strategy like '%milp' then 'Optimal' end as solver_status,
  case when strategy like '%milp' then total_cost end as solver_objective
from ({decision("seven")})"""


@query("o10_comparison", w(SEVEN, _O10))
def o10(spark, sf):
    table = selection.comparison_table(_compared(spark, sf), u.PENALTY)
    return _money(table.drop("solver_status", "solver_objective"), ["strategy"]).join(
        table.select("strategy", "solver_status",
                     F.round("solver_objective", 4).alias("solver_objective")), "strategy")


@query("o8_objectives", w(SEVEN, f"""select strategy, 'Optimal' as solver_status,
  total_cost as solver_objective from ({decision("seven")}) where strategy like '%milp'"""))
def o8(spark, sf):
    table = selection.comparison_table(_compared(spark, sf), u.PENALTY)
    return table.where(F.col("solver_status").isNotNull()).select(
        "strategy", "solver_status", F.round("solver_objective", 4).alias("solver_objective"))


@query("u1_union_strategies", w(SEVEN, """
select strategy, count(*) as rows, sum(case when selected then 1 else 0 end)::bigint as operated
from seven group by strategy"""))
def u1(spark, sf):
    return _compared(spark, sf).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("selected").alias("operated"))


_J3 = ", ".join(f"max(case when strategy = '{s}' then cast(selected as int) end) as selected_{s}"
                for s in selection.POLICIES + selection.OPTIMA)


@query("j3_decision_table", w(SEVEN, f"""
select unit_id, value, round(probability, 9) as probability, target, carrier, airport, {_J3}
from seven group by unit_id, value, probability, target, carrier, airport"""))
def j3(spark, sf):
    keys = ["unit_id", "value", "probability", "target", "carrier", "airport"]
    wide = selection.decisions(_compared(spark, sf), keys,
                               selection.POLICIES + selection.OPTIMA)
    return wide.withColumn("probability", F.round("probability", 9))


@query("o11_reduction", w(FIVE, f"""
select round(1 - max(case when strategy = 'net_score' then total_cost end)
  / max(case when strategy = 'random' then total_cost end), 6) as cost_reduction,
  round(1 - max(case when strategy = 'net_score' then risk_sum end)
  / max(case when strategy = 'random' then risk_sum end), 6) as risk_reduction
from ({decision("five")})"""))
def o11(spark, sf):
    marked = selection.policies(u.scored(spark, sf), u.PENALTY, u.CAPACITY, u.RANDOM_SEED)
    table = selection.decision_metrics(marked, u.PENALTY)
    return selection.reduction(table).select(*r6("cost_reduction", "risk_reduction"))


GRID = SCORED + """,
grid as (select unnest([1000, 2000, 3000, 4000])::double as penalty),
gridded as (select penalty, unit_id, value, probability, row_number() over (partition by penalty
  order by value - penalty * probability desc, unit_id desc) as r from scored, grid),
caps as (select unnest([0.4::double, 0.5::double, 0.6::double, 0.7::double, 0.8::double])
         as capacity),
cells as (select penalty, capacity,
    sum(case when r <= floor((select count(*) from scored) * capacity) then 0 else value end) as loss,
    sum(case when r <= floor((select count(*) from scored) * capacity) then probability else 0 end)
      as risk,
    sum(case when r <= floor((select count(*) from scored) * capacity) then 1 else 0 end) as n
  from gridded, caps group by penalty, capacity)"""


@query("o9_scenario_grid", w(GRID, """
select penalty, capacity, round(loss + penalty * risk, 4) as total_cost,
  round(loss, 4) as commercial_loss, round(penalty * risk, 4) as expected_penalty,
  round(risk, 6) as risk_sum, round(risk / n, 6) as average_probability,
  cast(n as bigint) as operated from cells"""))
def o9(spark, sf):
    grid = selection.scenarios(u.scored(spark, sf), u.PENALTIES, u.CAPACITIES)
    return _money(grid, ["penalty", "capacity"])


@query("j6_penalty_capacity_units", w(GRID, """
select penalty, capacity, cast(n as bigint) as operated from cells"""))
def j6(spark, sf):
    grid = selection.scenarios(u.scored(spark, sf), u.PENALTIES, u.CAPACITIES)
    return grid.select("penalty", "capacity", "operated")


@query("a11_scenario_cost_matrix", w(GRID, "select penalty, " + ", ".join(
    f"round(max(case when capacity = {c}::double then (loss + penalty * risk) / 1e6 end), 6)"
    f" as c{round(c * 100)}" for c in u.CAPACITIES) + " from cells group by penalty"))
def a11_cost(spark, sf):
    grid = selection.scenarios(u.scored(spark, sf), u.PENALTIES, u.CAPACITIES)
    return selection.scenario_matrix(grid, u.CAPACITIES, F.round(F.col("total_cost") / 1e6, 6))


@query("a11_scenario_risk_matrix", w(GRID, "select penalty, " + ", ".join(
    f"round(max(case when capacity = {c}::double then risk / n end), 6) as c{round(c * 100)}"
    for c in u.CAPACITIES) + " from cells group by penalty"))
def a11_risk(spark, sf):
    grid = selection.scenarios(u.scored(spark, sf), u.PENALTIES, u.CAPACITIES)
    return selection.scenario_matrix(grid, u.CAPACITIES, F.round("average_probability", 6))


@query("w7_cost_order", w(FIVE, f"""
select strategy, total_cost, row_number() over (order by total_cost desc, strategy) as place
from ({decision("five")})"""))
def w7(spark, sf):
    marked = selection.policies(u.scored(spark, sf), u.PENALTY, u.CAPACITY, u.RANDOM_SEED)
    table = _money(selection.decision_metrics(marked, u.PENALTY), ["strategy"])
    # One row per strategy.
    place = F.row_number().over(W.orderBy(F.desc("total_cost"), "strategy"))
    return table.select("strategy", "total_cost", place.cast("bigint").alias("place")).orderBy(
        "place")


# -- integrity -------------------------------------------------------------------------------

def tree_sql(source: str, text: str) -> str:
    level = f"select unit_id as k, {text} as t from {source}"
    for _ in range(integrity.LEVELS):
        level = (f"select k >> {integrity.LEVEL_BITS} as k, sha256(string_agg(t, ',' order by k))"
                 f" as t from ({level}) group by k >> {integrity.LEVEL_BITS}")
    return f"select t as sha256 from ({level})"


@query("l1_test_hash", w(SPLIT, tree_sql("test", "cast(unit_id as varchar)")))
def l1(spark, sf):
    return integrity.ordered_hash(u.test_of(u.parts(spark, sf)), "unit_id")


@query("l4_prediction_hash", w(SCORED, tree_sql(
    "scored", "unit_id || ':' || cast(round(probability * 1000000) as bigint)")))
def l4(spark, sf):
    micro = F.round(F.col("probability") * 1_000_000).cast("bigint")
    return integrity.ordered_hash(u.scored(spark, sf), "unit_id", micro)


@query("k7_pending_work", w(SPLIT, """
select w.carrier, w.year from (select distinct carrier, year from parts) w
where not exists (select 1 from parts p where p.part = 'test' and p.airport < 'E'
  and p.carrier = w.carrier and p.year = w.year and p.month = 1)"""))
def k7(spark, sf):
    rows = u.parts(spark, sf)
    work = rows.select("carrier", "year").distinct()
    done = rows.where("part = 'test' and airport < 'E' and month = 1").select("carrier", "year")
    return integrity.pending(work, done.distinct(), ["carrier", "year"])


@query("k4_write_once", w(SPLIT, """
select carrier, cast(count(*) as varchar) as payload from test group by carrier"""))
def k4(spark, sf):
    path = u.work_path(spark, "checkpoints")
    rows = u.test_of(u.parts(spark, sf)).groupBy("carrier").agg(
        F.count(F.lit(1)).cast("string").alias("payload"))
    integrity.write_once(rows.where(F.col("carrier") < "F"), path, ["carrier"])
    integrity.write_once(rows, path, ["carrier"])
    return integrity.read_table(spark, path).select("carrier", "payload")
