"""Registered queries: learners and tuning."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctua.operators import evaluate, features, integrity, learners, newton, prepare, split, tune
from punctua.plans import units as u
from punctua.plans.basic import SCALED_SQL, folds_sql, r6
from punctua.plans.decisions import MODELS_SQL, model_scores
from punctua.plans.oracle import PREPARED, SPLIT, metrics, w
from punctua.plans.registry import query

COLUMNS = ["unit_id", *prepare.FEATURES, "target"]


def train_test(spark, sf):
    rows = u.parts(spark, sf)
    return (u.stage(u.train_of(rows).select(*COLUMNS), "train"),
            u.stage(u.test_of(rows).select(*COLUMNS), "test"))


# -- learners --------------------------------------------------------------------------------

NB = SCALED_SQL + ",\nnb as (select target, cast(count(*) as double) as n, " + ", ".join(
    f"avg({c}) as m_{c}, var_pop({c}) as v_{c}" for c in features.SCALED
) + """ from scaled where part = 'train' and kept group by target),
wide as (select 1e-9::double * greatest(""" + ", ".join(
    f"var_pop({c})" for c in features.SCALED
) + """) as eps from scaled where part = 'train' and kept),
joint as (select unit_id, s.target as actual, nb.target, ln(n / (select sum(n) from nb))""" + "".join(
    f" - ln(6.283185307179586::double * (v_{c} + eps)) / 2"
    f" - ({c} - m_{c}) * ({c} - m_{c}) / (2 * (v_{c} + eps))" for c in features.SCALED
) + """ as lj from scaled s, nb, wide where s.part = 'test')"""


@query("m7_gaussian_nb", w(NB, """
select unit_id, round(1 / (1 + exp(max(case when target = 0 then lj end)
  - max(case when target = 1 then lj end))), 6) as probability from joint group by unit_id"""))
def m7(spark, sf):
    train, test = train_test(spark, sf)
    model = learners.fit("gaussian_nb", train, {"var_smoothing": 1e-9}, 42)
    return model.score(test).select("unit_id", *r6("probability"))


def knn_sql(k: int, power: int, weights: str) -> str:
    """Brute force over all test x train pairs."""
    gaps = [f"abs(q.x_{c} - t.x_{c}) / s_{c}" for c in prepare.CATEGORICAL + prepare.NUMERIC]
    dist = " + ".join(g if power == 1 else f"({g}) * ({g})" for g in gaps)
    gap = "d" if power == 1 else "sqrt(d)"
    vote = "avg(target)" if weights == "uniform" else f"""case when min(d) = 0
      then avg(case when d = 0 then target end)
      else sum(target / nullif({gap}, 0)) / sum(1 / nullif({gap}, 0)) end"""
    return w(SCALED_SQL + f""",
pairs as (select q.unit_id, t.unit_id as tid, t.target, round({dist}, 9) as d
  from encoded q, encoded t, stats
  where q.part = 'test' and t.part = 'train' and t.kept),
near as (select * from pairs
  qualify row_number() over (partition by unit_id order by d, tid) <= {k})""", f"""
select unit_id, round({vote}, 6) as probability from near group by unit_id""")


def _knn(name, k, power, weights):
    @query(name, knn_sql(k, power, weights))
    def run(spark, sf):
        train, test = train_test(spark, sf)
        params = {"n_neighbors": k, "p": power, "weights": weights}
        return learners.fit("knn", train, params, 42).score(test).select(
            "unit_id", *r6("probability"))

    return run


_knn("m6_knn", 15, 2, "uniform")
_knn("m6_knn_manhattan_weighted", 9, 1, "distance")


# A fitted probability is no SQL; what SQL states is the rows, the range and that the model ranks
# the test rows better than a constant does.
CHECKED = w(SPLIT, """
select unit_id, target, true as in_range, true as above_chance from test""")


def checked(scored):
    """(unit_id, target, in_range, above_chance) of scored test rows."""
    rows = u.stage(scored.select("unit_id", "target", "probability"), "scored")
    auc = evaluate.metrics(rows.withColumn("model", F.lit("m")), ["model"]).first()["roc_auc"]
    return rows.select("unit_id", "target", F.coalesce(
        F.col("probability").between(0.0, 1.0), F.lit(False)).alias("in_range"),
        F.lit(auc > 0.5).alias("above_chance"))


def _learner(key, name, params):
    @query(key, CHECKED)
    def run(spark, sf):
        train, test = train_test(spark, sf)
        return checked(learners.fit(name, train, params, 42).score(test))

    return run


SLOTS = """,
cats as (select 'c' as f, carrier as v, count(*) as n from train group by carrier
         union all select 'a', airport, count(*) from train group by airport),
width as (select (select count(*) from cats where n >= 2) + (select count(distinct f) from cats
            where n < 2) + %d as d)""" % (len(prepare.NUMERIC) + 1)


@query("m8_early_stopping", "select true as is_best, true as ends_by_rule")
def m8_stop(spark, sf):
    """The reported round, found again by SQL on the written losses of the stages."""
    train, _ = train_test(spark, sf)
    model = learners.fit("mlp", train, learners.defaults("mlp"), 42)
    u.stage(model.info["losses"], "losses").createOrReplaceTempView("network_losses")
    return spark.sql(f"""
      with running as (select iteration, loss, coalesce(min(loss) over (order by iteration rows
               between unbounded preceding and 1 preceding), double('inf')) as before
             from network_losses),
      marked as (select iteration, loss, max(case when loss < before then iteration end)
               over (order by iteration) as best from running)
      select max_by(best, iteration) = {model.info["best_iteration"]} as is_best,
             count_if(iteration - best >= 10 and iteration < last) = 0
             and (max(iteration) >= 250 or max_by(iteration - best, iteration) >= 10) as ends_by_rule
      from marked, (select max(iteration) as last from network_losses)""")


@query("m9_ridge_optimum", w(SPLIT + SLOTS, """
select cast(unnest(range(d)) as int) as slot, true as at_optimum from width"""))
def m9_optimum(spark, sf):
    """The gradient of the penalised log-loss at the fitted plane, per weight."""
    train, _ = train_test(spark, sf)
    model = learners.fit("logistic_regression", train, {"C": 1.0}, 42)
    plane = [*model.info["model"].coefficients.toArray().tolist(), 0.0]
    rows = model.info["encoded"](train)
    p = vector_to_array("probability")[1]
    pulls = model.info["model"].transform(rows).select(
        F.posexplode(F.array_append(vector_to_array("features"), F.lit(1.0))).alias("slot", "x"),
        (p - F.col("target")).alias("gap")).where("x <> 0").groupBy("slot").agg(
        F.sum(F.col("x") * F.col("gap")).alias("pull"))
    weights = spark.range(1).select(F.posexplode(F.array(*map(F.lit, plane))).alias("slot", "w"))
    gradient = F.abs(F.col("w") + F.coalesce("pull", F.lit(0.0)))
    return weights.join(pulls, "slot", "left").select(
        "slot", (gradient < 1e-6 * train.count()).alias("at_optimum"))


@query("m10_hinge_optimum", w(SPLIT + SLOTS, """
select fold, cast(slot as int) as slot, true as at_optimum
from (select unnest(range(5))::int as fold), (select unnest(range(d)) as slot from width)"""))
def m10_optimum(spark, sf):
    """The gradient of the squared-hinge objective at the plane of every fold, per weight."""
    train, _ = train_test(spark, sf)
    model = learners.fit("linear_svm", train, learners.defaults("linear_svm"), 42)
    encoded = u.stage(model.info["encoded"].select(
        "fold", "features", F.col("target").cast("double").alias("label")), "encoded")
    parts = [newton.hinge_gradient(encoded.where(F.col("fold") != fold), plane, 1.0).select(
        F.lit(fold).alias("fold"), "slot", (F.abs("gradient") < 1e-6).alias("at_optimum"))
        for fold, plane in enumerate(model.info["planes"])]
    return reduce(DataFrame.unionByName, parts)


# The published settings; a query with SQL has the folds that its SQL names.
PUBLISHED = tune.Protocol()
BASES = {n: {"params": learners.defaults(n), "iterations": 300} for n in learners.BOOSTING}
_learner("m1_random_forest", "random_forest", learners.defaults("random_forest"))
_learner("m2_extra_trees", "extra_trees", learners.defaults("extra_trees"))
_learner("m3_boosting_depthwise", "xgboost", learners.defaults("xgboost"))
_learner("m4_boosting_leafwise", "lightgbm", learners.defaults("lightgbm"))
_learner("m5_boosting_symmetric", "catboost", learners.defaults("catboost"))
_learner("m8_mlp", "mlp", learners.defaults("mlp"))
_learner("m9_logistic_regression", "logistic_regression", {"C": 1.0})
_learner("m10_calibrated_svm", "linear_svm", learners.defaults("linear_svm"))


@query("m11_stack_oof_rows", w(folds_sql("stack42", 2), """
select unit_id, target, fold, 3::bigint as bases, true as in_range from folds"""))
def m11(spark, sf):
    train, _ = train_test(spark, sf)
    folded = u.stage(split.stratified_folds(train, 2, "stack42", "unit_id"), "folded")
    long = learners.out_of_fold(folded, BASES, 2, 42, "unit_id")
    inside = F.col("probability").between(0.0, 1.0)
    return long.groupBy("unit_id", "target", "fold").agg(
        F.count_distinct("model").alias("bases"), F.bool_and(inside).alias("in_range"))


@query("m11_stacking", CHECKED)
def m11_fit(spark, sf):
    train, test = train_test(spark, sf)
    model = learners.fit("stacking", train, {"folds": PUBLISHED.stack_folds, "C": 1.0}, 42, specs=BASES)
    return checked(model.score(test))


# Month series of each segment's late rate stand for the loss series of a boosted model.
@query("m13_patience_rule", w(PREPARED, """
select carrier, cast(coalesce(min_by(best, iteration) filter (iteration - best >= 5),
  max_by(best, iteration)) as int) as best_iteration
from (select *, max(case when loss < prev or prev is null then iteration end)
        over (partition by carrier order by iteration) as best
      from (select *, min(loss) over (partition by carrier order by iteration
                rows between unbounded preceding and 1 preceding) as prev
            from (select carrier, (year - 1992) * 12 + month as iteration,
                    sum(arr_del15) / sum(arr_flights) as loss
                  from prepared group by carrier, year, month)))
group by carrier"""))
def m13(spark, sf):
    losses = u.labelled(spark, sf).groupBy(
        "carrier", ((F.col("year") - 1992) * 12 + F.col("month")).alias("iteration")
    ).agg((F.sum("arr_del15") / F.sum("arr_flights")).alias("loss"))
    return learners.patience_stop(losses, 5, ["carrier"])


@query("m13_early_stopped_boosting", w(SPLIT, """
select unit_id, target, true as in_range, true as above_chance, true as rounds_within from test"""))
def m13_fit(spark, sf):
    train, test = train_test(spark, sf)
    model = learners.early_stopped("xgboost", train, learners.defaults("xgboost"), 42, "unit_id",
                                   PUBLISHED.max_rounds, PUBLISHED.patience)
    within = 1 <= model.info["best_iteration"] <= PUBLISHED.max_rounds
    return checked(model.score(test)).withColumn("rounds_within", F.lit(within))


@query("m14_refit_selected", CHECKED)
def m14(spark, sf):
    train, test = train_test(spark, sf)
    model = tune.fit_spec("catboost", train, BASES["catboost"], {}, PUBLISHED, 42)
    return checked(model.score(test))


# -- tuning ----------------------------------------------------------------------------------

SMOOTHINGS = [1e-12, 1e-9, 1e-6, 1e-1]

_COLS = prepare.CATEGORICAL + prepare.NUMERIC
CV_SQL = folds_sql("inner42", 2) + """,
cvt as (select folds.*, f from folds, (select unnest([0, 1]) as f) where fold <> f),
cvc as (select f, carrier, row_number() over (partition by f order by carrier) - 1 as code
        from cvt group by f, carrier),
cva as (select f, airport, row_number() over (partition by f order by airport) - 1 as code
        from cvt group by f, airport),
cve as (select x.unit_id, x.fold, x.f, x.fold = x.f as held, x.target,
    cast(coalesce(cvc.code, -1) as double) as x_carrier,
    cast(coalesce(cva.code, -1) as double) as x_airport, cast(year as double) as x_year,
    cast(month as double) as x_month, arr_flights as x_arr_flights
  from (select folds.*, f from folds, (select unnest([0, 1]) as f)) x
  left join cvc on x.f = cvc.f and x.carrier = cvc.carrier
  left join cva on x.f = cva.f and x.airport = cva.airport),
cvs as (select f, """ + ", ".join(
    f"avg(x_{c}) as m_{c}, stddev_pop(x_{c}) as s_{c}" for c in _COLS
) + """ from cve where not held group by f),
cvz as (select unit_id, cve.f, held, target, """ + ", ".join(
    f"(x_{c} - m_{c}) / s_{c} as z_{c}" for c in _COLS
) + """ from cve join cvs using (f)),
cvn as (select f, target, cast(count(*) as double) as n, """ + ", ".join(
    f"avg({c}) as m_{c}, var_pop({c}) as v_{c}" for c in features.SCALED
) + """ from cvz where not held group by f, target),
cvw as (select f, greatest(""" + ", ".join(f"var_pop({c})" for c in features.SCALED) + """) as top,
    cast(count(*) as double) as total from cvz where not held group by f),
cands as (select unnest([0, 1, 2, 3]) as candidate,
          unnest([1e-12::double, 1e-9::double, 1e-6::double, 1e-1::double]) as smoothing),
cvj as (select candidate, cvz.f as fold, unit_id, cvz.target as actual, cvn.target,
    ln(n / total)""" + "".join(
    f" - ln(6.283185307179586::double * (v_{c} + smoothing * top)) / 2"
    f" - ({c} - m_{c}) * ({c} - m_{c}) / (2 * (v_{c} + smoothing * top))"
    for c in features.SCALED
) + """ as lj from cvz join cvn using (f) join cvw using (f), cands where held),
cvp as (select candidate * 10 + fold as cell, actual as target,
    1 / (1 + exp(max(case when target = 0 then lj end) - max(case when target = 1 then lj end)))
      as probability from cvj group by candidate, fold, unit_id, actual),
""" + metrics("cvp", "cell", digits=None).lstrip()

_CELL = "cast(cell // 10 as int) as candidate, cast(cell % 10 as int) as fold"


def gaussian_cv(spark, sf):
    """Fold metrics of every smoothing candidate, unrounded."""
    train, _ = train_test(spark, sf)
    folded = u.stage(split.stratified_folds(train, 2, "inner42", "unit_id"), "folded")
    params = [{"var_smoothing": s} for s in SMOOTHINGS]
    return tune.cross_validate("gaussian_nb", folded, params, tune.SMOKE_RUN, 42)


@query("h4_candidate_fold_metrics", w(CV_SQL, f"select {_CELL}, " + ", ".join(
    f"round({c}, 6) as {c}" for c in evaluate.METRICS) + " from metrics"))
def h4(spark, sf):
    return gaussian_cv(spark, sf).select("candidate", "fold", *r6(*evaluate.METRICS))


SUMMARY = f"""
summary as (select candidate, avg(roc_auc) as mean_roc_auc, stddev_samp(roc_auc) as std_roc_auc,
    avg(pr_auc) as mean_pr_auc, avg(brier) as mean_brier, avg(f1) as mean_f1
  from (select {_CELL}, * from metrics) group by candidate)"""
_SIX = ["mean_roc_auc", "std_roc_auc", "mean_pr_auc", "mean_brier", "mean_f1"]


@query("a6_candidate_summary", w(CV_SQL + "," + SUMMARY, "select candidate, " + ", ".join(
    f"round({c}, 5) as {c}" for c in _SIX) + " from summary"))
def a6(spark, sf):
    table = tune.summarize_candidates(gaussian_cv(spark, sf))
    return table.select("candidate", *[F.round(c, 5).alias(c) for c in _SIX])


@query("h5_one_standard_error", w(CV_SQL + "," + SUMMARY + """,
top as (select * from summary order by mean_roc_auc desc, candidate limit 1)""", """
select candidate from summary
where mean_roc_auc >= (select mean_roc_auc - std_roc_auc / sqrt(2) from top)
order by mean_brier, candidate limit 1"""))
def h5(spark, sf):
    summary = tune.summarize_candidates(gaussian_cv(spark, sf))
    return tune.choose_one_standard_error(summary, 2).select("candidate")


@query("a5_nested_summary", w(MODELS_SQL + """,
mf as (select model, cast(month % 3 as int) as outer_fold, models.probability, models.target
       from models join test using (unit_id)),
keyed as (select model || '/' || outer_fold as cell, probability, target from mf),
""" + metrics("keyed", "cell", digits=None).lstrip(), """
select split_part(cell, '/', 1) as model, round(avg(roc_auc), 5) as mean_roc_auc,
  round(stddev_samp(roc_auc), 5) as std_roc_auc, round(avg(pr_auc), 5) as mean_pr_auc,
  round(avg(brier), 5) as mean_brier, round(avg(f1), 5) as mean_f1
from metrics group by split_part(cell, '/', 1)"""))
def a5(spark, sf):
    months = u.units(spark, sf).select("unit_id", (F.col("month") % 3).alias("outer_fold"))
    rows = model_scores(spark, sf).join(months, "unit_id")
    table = evaluate.metrics(rows, ["model", "outer_fold"])
    summary = tune.nested_summary(table)
    return summary.select("model", *[F.round(c, 5).alias(c) for c in _SIX])


@query("h7_nested_cv")
def h7(spark, sf):
    train, _ = train_test(spark, sf)
    return tune.nested_cv(train, PUBLISHED, u.work_path(spark, "checkpoints"))


@query("h9_final_tuning_frozen_test")
def h9(spark, sf):
    train, test = train_test(spark, sf)
    path = u.work_path(spark, "run")
    specs = tune.final_tuning(train, PUBLISHED, path + "/checkpoints")
    test_hash = integrity.ordered_hash(test, "unit_id").first()["sha256"]
    integrity.freeze(spark, path + "/freeze", specs, test_hash, False)
    return tune.evaluate_frozen(train, test, specs, PUBLISHED, path + "/checkpoints",
                                path + "/predictions", path + "/freeze", False)


@query("h3_inner_cv_boosting")
def h3(spark, sf):
    train, _ = train_test(spark, sf)
    folded = u.stage(split.stratified_folds(train, PUBLISHED.inner_folds, "inner42", "unit_id"),
                     "folded")
    params = tune.protocol_candidates(spark, "catboost", PUBLISHED, 42)
    return tune.cross_validate("catboost", folded, params, PUBLISHED, 42)


@query("h8_meta_search", """
select candidate, fold, true as in_range
from (select unnest(range(13))::int as candidate), (select unnest(range(5))::int as fold)""")
def h8(spark, sf):
    train, _ = train_test(spark, sf)
    folds = PUBLISHED.stack_folds
    folded = u.stage(split.stratified_folds(train, folds, "stack42", "unit_id"), "folded")
    long = learners.out_of_fold(folded, BASES, folds, 42, "unit_id")
    oof = u.stage(learners.meta_features(long, ["unit_id", "target", "fold"]), "oof")
    params = tune.protocol_candidates(spark, "stacking", PUBLISHED, 42)
    found = tune.meta_search(oof, params, folds)
    inside = [F.col(c).between(0.0, 1.0) for c in evaluate.METRICS]
    return found.select("candidate", "fold", reduce(lambda a, b: a & b, inside).alias("in_range"))
