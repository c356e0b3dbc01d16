"""Choosing units under a capacity.

Rows carry ``unit_id``, ``value``, ``probability``, ``target`` and a group column. The optima
need no solver: with mandatory units, disjoint group minima and one global cap, the gain of a
group is concave in the number of units taken, so filling by net score is exact.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctua.functions.columns import seeded_hash
from punctua.operators import order
from punctua.session import settle, small_table

ID = "unit_id"
POLICIES = ["random", "value_only", "risk_only", "net_score", "binary_label_policy"]
OPTIMA = ["capacity_only_milp", "structural_milp"]


def commercial_values(df: DataFrame, low: int, high: int, seed: str) -> DataFrame:
    """Seeded uniform whole-number ``value`` in [low, high] (O1)."""
    if low > high:
        raise ValueError(f"Values cannot be drawn between {low} and {high}: the range is empty.")
    drawn = seeded_hash(seed, ID) % F.lit(high - low + 1) + F.lit(low)
    return df.withColumn("value", drawn.cast("double"))


def capacity_count(size: int, capacity: float) -> int:
    if not 0 < capacity <= 1:
        raise ValueError(f"A capacity of {capacity} is no share above 0 and up to 1.")
    return floor(size * float(capacity))


def net_score(penalty: float, risk: str = "probability") -> Column:
    return F.col("value") - F.lit(float(penalty)) * F.col(risk)


def _one_quota(df: DataFrame, n: int, k: int) -> DataFrame:
    return small_table(df.sparkSession, [(n, k)], "n bigint, k bigint")


def _bad_risk(risk: str = "probability") -> Column:
    """Counts the rows whose risk is no probability; NaN is above every number."""
    return F.count_if(~F.coalesce(F.col(risk).between(0.0, 1.0), F.lit(False))).alias("_bad")


def _refuse(bad: int | None) -> None:
    if bad:
        raise ValueError(f"{bad} units have a risk that is null or outside of 0 to 1.")


def _counted(df: DataFrame) -> int:
    """Number of candidate units, which all need a probability."""
    n, bad = df.agg(F.count(F.lit(1)), _bad_risk()).first()
    _refuse(bad)
    return n


def policies(df: DataFrame, penalty: float, capacity: float, seed: str) -> DataFrame:
    """Five ranking policies in long form (O3): the rows with ``strategy`` and ``selected``.

    Every policy is one descending order on (score, tie). The ascending ones negate both
    columns, so one call marks all five without a sort of the whole table.
    """
    n = _counted(df)
    k = capacity_count(n, capacity)

    def entry(name: str, score: Column, flip: bool = False):
        sign = F.lit(-1 if flip else 1)
        return F.struct(F.lit(name).alias("strategy"), (score * sign).alias("score"),
                        (F.col(ID) * sign).alias("tie"))

    long = df.withColumn("_s", F.explode(F.array(
        entry("random", seeded_hash(seed, ID).cast("double"), flip=True),
        entry("value_only", F.col("value")),
        entry("risk_only", F.col("probability"), flip=True),
        entry("net_score", net_score(penalty)),
        entry("binary_label_policy", net_score(penalty, "target")),
    ))).select(*df.columns, "_s.*")
    quotas = small_table(
        df.sparkSession, [(name, n, k) for name in POLICIES],
        "strategy string, n bigint, k bigint",
    )
    return order.top_k(long, "score", "tie", quotas, ["strategy"]).drop("score", "tie")


def capacity_optimum(df: DataFrame, penalty: float, capacity: float) -> DataFrame:
    """Cost optimum under the capacity alone (O4): best net scores, and only positive ones."""
    scored = df.withColumn("_net", net_score(penalty))
    n, positive, bad = scored.agg(F.count(F.lit(1)), F.count_if(F.col("_net") > 0),
                                  _bad_risk()).first()
    _refuse(bad)
    k = min(capacity_count(n, capacity), positive)
    marked = order.top_k(scored, "_net", ID, _one_quota(df, n, k))
    return marked.drop("_net").withColumn("strategy", F.lit("capacity_only_milp"))


def mandatory_units(df: DataFrame, fraction: float, seed: str) -> DataFrame:
    """Mark floor(n * fraction) seeded units as ``mandatory``."""
    if not 0 <= fraction <= 1:
        raise ValueError("The mandatory fraction must be in [0, 1].")
    n = df.count()
    quota = small_table(df.sparkSession, [(floor(n * float(fraction)), n)], "k bigint, n bigint")
    return order.first_by_hash(df, ID, seed, quota, out="mandatory")


def require_known(df: DataFrame, wanted: DataFrame) -> None:
    """Mandatory ids given as a table must be in the candidate set."""
    if not wanted.join(df.select(ID), ID, "left_anti").isEmpty():
        raise ValueError("Some mandatory units lie outside the table of candidates.")


def structural_optimum(df: DataFrame, penalty: float, capacity: float, group: str,
                       fraction: float) -> DataFrame:
    """Cost optimum with ``mandatory`` units and a minimum share per group.

    Mandatory units first; then per group the best net scores up to ceil(n_g * fraction), even
    at negative net; then the best positive net scores overall within what is left.
    """
    if not 0 <= fraction <= 1:
        raise ValueError(f"A group minimum of {fraction} is no share from 0 to 1.")
    scored = df.withColumn("_net", net_score(penalty))
    groups = settle(scored.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("mandatory").alias("_m"), _bad_risk()
    ))
    minimum = F.ceil(F.col("_n") * F.lit(float(fraction)))
    quotas = settle(groups.select(
        group, (F.col("_n") - F.col("_m")).alias("n"),
        F.greatest(minimum - F.col("_m"), F.lit(0)).cast("bigint").alias("k"),
    ))
    total, fixed, bad = groups.agg(F.sum("_n"), F.sum("_m"), F.sum("_bad")).first()
    _refuse(bad)
    needed = quotas.agg(F.sum("k")).first()[0]
    cap = capacity_count(total, capacity)
    if fixed > cap:
        raise ValueError(f"Mandatory units ({fixed}) are more than the capacity ({cap}) holds.")
    if fixed + needed > cap:
        raise RuntimeError(
            f"Infeasible: {fixed} mandatory units and {needed} for group minima exceed {cap}.")
    forced = scored.where("mandatory").withColumn("selected", F.lit(True))
    second = order.top_k(scored.where("not mandatory"), "_net", ID, quotas, [group], out="_own")
    rest = second.where(~F.col("_own")).drop("_own")
    sizes = rest.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_net") > 0).alias("p"))
    n, positive = sizes.first()
    k = min(cap - fixed - needed, positive)
    third = order.top_k(rest, "_net", ID, _one_quota(df, n, k))
    taken = second.where("_own").drop("_own").withColumn("selected", F.lit(True))
    marked = forced.unionByName(taken).unionByName(third)
    return marked.drop("_net").withColumn("strategy", F.lit("structural_milp"))


def decision_metrics(marked: DataFrame, penalty: float, by: list[str] | None = None):
    """Costs and risk per policy (A7, O7); the mean probability of no unit is null."""
    by = by or ["strategy"]
    chosen = F.col("selected")
    risk = F.sum(F.when(chosen, F.col("probability")).otherwise(0.0))
    sums = marked.groupBy(*by).agg(
        F.sum(F.when(chosen, 0.0).otherwise(F.col("value"))).alias("commercial_loss"),
        risk.alias("risk_sum"),
        F.count_if(chosen).alias("operated"),
    )
    return _costs(sums, penalty).select(
        *by, "total_cost", "commercial_loss", "expected_penalty", "risk_sum",
        "average_probability", "operated",
    )


def _costs(sums: DataFrame, penalty: float | Column) -> DataFrame:
    penalty = F.lit(float(penalty)) if isinstance(penalty, (int, float)) else penalty
    expected = penalty * F.col("risk_sum")
    return sums.withColumns({
        "expected_penalty": expected,
        "total_cost": F.col("commercial_loss") + expected,
        "average_probability": F.try_divide(
            F.col("risk_sum"), F.col("operated").cast("double")
        ),
    })


def scenarios(df: DataFrame, penalties: list[float], capacities: list[float]) -> DataFrame:
    """Net-score ranking over a penalty x capacity grid.

    The order depends on the penalty alone, so units are multiplied by the penalties only. All
    capacities are conditional sums of one aggregate per penalty.
    """
    n = _counted(df)
    counts = [capacity_count(n, c) for c in capacities]
    long = df.withColumn(
        "penalty", F.explode(F.array(*[F.lit(float(p)) for p in penalties]))
    ).withColumn("_net", F.col("value") - F.col("penalty") * F.col("probability"))
    asked = [(float(p), n - k) for p in penalties for k in sorted(set(counts))]
    quotas = small_table(df.sparkSession, asked, "penalty double, k bigint")
    cuts = order.cut_points(long, "_net", ID, quotas, ["penalty"])
    # All cuts of a penalty as one map, so that the units are joined once.
    entry = F.struct("k", F.struct("cut_value", "cut_id"))
    cuts = settle(cuts.groupBy("penalty").agg(F.map_from_entries(F.collect_list(entry)).alias("_c")))
    ranked, chosen = long.join(cuts, "penalty", "left"), []
    for i, k in enumerate(counts):
        cut = F.col("_c")[F.lit(n - k).cast("bigint")]
        ranked = ranked.withColumn(f"_v{i}", cut["cut_value"]).withColumn(f"_i{i}", cut["cut_id"])
        chosen.append(~order.up_to("_net", ID, f"_v{i}", f"_i{i}"))
    aggs = []
    for i, yes in enumerate(chosen):
        aggs += [
            F.sum(F.when(yes, 0.0).otherwise(F.col("value"))).alias(f"loss{i}"),
            F.sum(F.when(yes, F.col("probability")).otherwise(0.0)).alias(f"risk{i}"),
            F.count_if(yes).alias(f"took{i}"),
        ]
    cells = F.explode(F.array(*[
        F.struct(F.lit(float(c)).alias("capacity"), F.col(f"loss{i}").alias("commercial_loss"),
                 F.col(f"risk{i}").alias("risk_sum"), F.col(f"took{i}").alias("operated"))
        for i, c in enumerate(capacities)
    ]))
    grid = ranked.groupBy("penalty").agg(*aggs).select("penalty", cells.alias("c"))
    return _costs(grid.select("penalty", "c.*"), F.col("penalty")).select(
        "penalty", "capacity", F.lit("net_score").alias("strategy"), "total_cost",
        "commercial_loss", "expected_penalty", "risk_sum", "average_probability", "operated",
    )


def scenario_matrix(grid: DataFrame, capacities: list[float], measure: Column) -> DataFrame:
    """One row per penalty, one column per capacity."""
    wide = grid.groupBy("penalty").pivot("capacity", [float(c) for c in capacities])
    table = wide.agg(F.first(measure))
    names = ["penalty"] + [f"c{round(c * 100)}" for c in capacities]
    return table.toDF(*names)


def compare(df: DataFrame, penalty: float, capacity: float, seed: str, group: str,
            group_fraction: float, mandatory_fraction: float, mandatory_seed: str) -> DataFrame:
    """Selections of the five policies and the two optima, long."""
    forced = mandatory_units(df, mandatory_fraction, mandatory_seed)
    structural = structural_optimum(forced, penalty, capacity, group, group_fraction)
    return (
        policies(df, penalty, capacity, seed)
        .unionByName(capacity_optimum(df, penalty, capacity))
        .unionByName(structural.drop("mandatory"))
    )


def comparison_table(marked: DataFrame, penalty: float) -> DataFrame:
    """Decision metrics per strategy; status and objective only for the optima."""
    table = decision_metrics(marked, penalty)
    solved = F.col("strategy").isin(OPTIMA)
    return table.withColumns({
        "solver_status": F.when(solved, F.lit("Optimal")),
        "solver_objective": F.when(solved, F.col("total_cost")),
    })


def decisions(marked: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per unit with a 0/1 column per strategy."""
    wide = marked.groupBy(*keys).pivot("strategy", names).agg(
        F.max(F.col("selected").cast("int"))
    )
    return wide.toDF(*keys, *[f"selected_{name}" for name in names])


def reduction(table: DataFrame, strategy: str = "net_score", against: str = "random"):
    """Relative cost and risk reduction of one strategy against another."""
    def of(name, column):
        return F.max(F.when(F.col("strategy") == name, F.col(column)))

    return table.agg(*[
        (1 - of(strategy, c) / of(against, c)).alias(out)
        for c, out in (("total_cost", "cost_reduction"), ("risk_sum", "risk_reduction"))
    ])
