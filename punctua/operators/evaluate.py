"""Ranking and threshold metrics, intervals and calibration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctua.functions.columns import seeded_hash
from punctua.operators import order
from punctua.session import settle, small_table, stage

BLOCK = 4096  # rows of a score table in one block
DRAWS_PER_TASK = 10_000_000
METRICS = ["roc_auc", "pr_auc", "f1", "brier", "accuracy", "precision", "recall"]


def require_probabilities(df: DataFrame, probability: str = "probability") -> None:
    bad = F.col(probability).isNull() | ~F.col(probability).between(0.0, 1.0)
    if df.agg(F.count_if(bad)).first()[0]:
        raise ValueError(f"Some values of {probability} are null or outside of 0 to 1.")


def score_cells(scores: DataFrame, by: list[str], probability: str = "probability",
                target: str = "target", weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score; the map-side combine shrinks ties."""
    one = F.col(weight) if weight else F.lit(1)
    positive = F.col(target) == 1
    return scores.groupBy(*by, F.col(probability).alias("p")).agg(
        F.sum(F.when(positive, one).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(positive, 0).otherwise(one)).cast("bigint").alias("neg"),
    )


def curve(scores: DataFrame, by: list[str], probability: str = "probability",
          target: str = "target") -> DataFrame:
    """Cumulative positives and negatives by descending score, one row per distinct score."""
    cells = score_cells(scores, by, probability, target)
    return order.prefix_sums(cells, "p", ["pos", "neg"], by, ascending=False)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def metrics_of_cells(cells: DataFrame, by: list[str], threshold: float = 0.5,
                     shared_bounds: bool = False) -> DataFrame:
    """All seven metrics per group from score cells, in one grouped aggregate.

    ROC-AUC counts a tie as half; PR-AUC is the step-form average precision. With a single
    class both are null, as are undefined ratios; F1, precision and recall are then 0.
    """
    rows = order.prefix_sums(cells, "p", ["pos", "neg"], by, ascending=False,
                             shared_bounds=shared_bounds)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    before = F.col("cum_pos") - F.col("pos")
    called = F.col("p") >= F.lit(float(threshold))
    sums = rows.groupBy(*by).agg(
        F.sum(pos).alias("_P"),
        F.sum(neg).alias("_N"),
        F.sum(neg * (before + pos / 2)).alias("_area"),
        F.sum(pos * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("_ap"),
        F.sum(F.when(called, pos).otherwise(0.0)).alias("_tp"),
        F.sum(F.when(called, neg).otherwise(0.0)).alias("_fp"),
        F.sum(pos * F.pow(F.col("p") - 1, F.lit(2)) + neg * F.pow("p", F.lit(2))).alias("_se"),
    )
    fn, tn = F.col("_P") - F.col("_tp"), F.col("_N") - F.col("_fp")
    total = F.col("_P") + F.col("_N")
    both = (F.col("_P") > 0) & (F.col("_N") > 0)
    zero = F.lit(0.0)
    return sums.select(
        *by,
        F.when(both, _ratio(F.col("_area"), F.col("_P") * F.col("_N"))).alias("roc_auc"),
        F.when(both, _ratio(F.col("_ap"), F.col("_P"))).alias("pr_auc"),
        F.coalesce(
            _ratio(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + fn), zero
        ).alias("f1"),
        _ratio(F.col("_se"), total).alias("brier"),
        _ratio(F.col("_tp") + tn, total).alias("accuracy"),
        F.coalesce(_ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")), zero).alias("precision"),
        F.coalesce(_ratio(F.col("_tp"), F.col("_P")), zero).alias("recall"),
    )


def metrics(scores: DataFrame, by: list[str], threshold: float = 0.5,
            probability: str = "probability", target: str = "target") -> DataFrame:
    """The seven metrics for every group (model, fold, candidate, ...) in one job."""
    return metrics_of_cells(score_cells(scores, by, probability, target), by, threshold)


def confusion(scores: DataFrame, by: list[str], threshold: float = 0.5,
              probability: str = "probability", target: str = "target") -> DataFrame:
    called = F.col(probability) >= F.lit(float(threshold))
    actual = F.col(target) == 1
    return scores.groupBy(*by).agg(
        F.count_if(called & actual).alias("tp"),
        F.count_if(called & ~actual).alias("fp"),
        F.count_if(~called & actual).alias("fn"),
        F.count_if(~called & ~actual).alias("tn"),
    )


@dataclass(frozen=True)
class DrawTable:
    """The rows of a score table in order of (score, class), as blocks of ``BLOCK`` rows.

    A block has the ends, starts, scores and positives of the cells that reach into it; a cell of
    many equal scores reaches into several. So a row number leads to its cell by one look at the
    block's number and a binary search in its ends.
    """

    blocks: DataFrame
    rows: int
    widest: int  # most cells in a block


def draw_table(scores: DataFrame, probability: str = "probability", target: str = "target"
               ) -> DrawTable:
    cells = score_cells(scores, [], probability, target).withColumn("c", F.col("pos") + F.col("neg"))
    ends = order.prefix_sums(cells, "p", ["c"]).withColumn("start", F.col("cum_c") - F.col("c"))
    reach = F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(cum_c - 1) div {BLOCK}"))
    entry = F.struct(F.col("cum_c").alias("end"), "start", "p", "pos")
    blocks = stage(ends.select(F.explode(reach).alias("block"), entry.alias("e")).groupBy("block").agg(
        F.sort_array(F.collect_list("e")).alias("e")).select(  # at most BLOCK cells
        "block", *[F.col(f"e.{c}").alias(c) for c in ("end", "start", "p", "pos")]), "draws")
    row = blocks.agg(F.max(F.array_max("end")), F.max(F.size("end"))).first()
    return DrawTable(blocks, row[0] or 0, row[1] or 0)


def bootstrap_cells(table: DrawTable, replicates: tuple[int, int], seed: str) -> DataFrame:
    """Score cells (replicate, p, pos, neg) of n-of-n draws with replacement.

    Draw d of replicate r takes the row number hash(r, d) mod n in order of (score, class). Draws
    are numbers, not rows: they are located in the blocks, and combined to one row for each
    replicate and cell before they are shuffled.
    """
    spark, n = table.blocks.sparkSession, table.rows
    first, last = replicates
    total = n * (last - first)
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // DRAWS_PER_TASK))
    draws = spark.range(n * first, n * last, 1, tasks).select(
        F.expr(f"id div {n}").alias("replicate"), (F.col("id") % n).alias("draw"))
    key = F.concat(F.col("replicate").cast("string"), F.lit("|"), F.col("draw").cast("string"))
    # No hash is null. Where Spark knows it, the join filters no nulls and each hash is taken once.
    row = F.coalesce(seeded_hash(seed, key) % F.lit(n), F.lit(0).cast("bigint"))
    at = draws.select("replicate", row.alias("at")).withColumn(
        "block", F.coalesce(F.expr(f"at div {BLOCK}"), F.lit(0).cast("bigint")))
    # The cell is the first one that ends behind the row: ends up to the row lie before it.
    found = order.locate(at.join(table.blocks, "block").withColumn("next", F.col("at") + 1), "end",
                         "next", "_k", table.widest)
    cell = found.select("replicate", F.get("p", F.col("_k")).alias("p"), (
        F.col("at") - F.get("start", F.col("_k")) < F.get("pos", F.col("_k"))).alias("positive"))
    return cell.groupBy("replicate", "p").agg(F.count_if("positive").alias("pos"),
                                              F.count_if(~F.col("positive")).alias("neg"))


def bootstrap(scores: DataFrame, id_col: str, samples: int, seed: str, threshold: float = 0.5,
              probability: str = "probability", target: str = "target") -> DataFrame:
    """Metrics of ``samples`` two-class replicates.

    Single-class replicates are left out and later ones take their place, up to ten times the
    asked number; then it is an error. Rows of one score and class are alike in every metric, so
    a draw needs only how many there are of each: ``id_col`` is not read.
    """
    table, kept, start = draw_table(scores, probability, target), None, 0
    while start < samples * 10 and table.rows:
        have = kept.count() if kept is not None else 0
        if have >= samples:
            break
        stop = min(start + max(samples - have, 1), samples * 10)
        cells = bootstrap_cells(table, (start, stop), seed)
        found = settle(
            metrics_of_cells(cells, ["replicate"], threshold, shared_bounds=True)
            .where(F.col("roc_auc").isNotNull())
        )
        kept = found if kept is None else kept.unionByName(found)
        start = stop
    if kept is None or kept.count() < samples:
        raise RuntimeError(f"Of {samples * 10} draws fewer than {samples} hold both classes.")
    return kept


def unpivot_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (keys..., metric, value)."""
    return df.unpivot(keys, METRICS, "metric", "value")


def bootstrap_intervals(scores: DataFrame, id_col: str, samples: int, seed: str,
                        threshold: float = 0.5, probability: str = "probability",
                        target: str = "target") -> DataFrame:
    """Point value and 2.5 % / 97.5 % bootstrap quantiles per metric."""
    replicates = bootstrap(scores, id_col, samples, seed, threshold, probability, target)
    # One value per replicate: the exact quantile holds ``samples`` numbers per metric.
    spread = unpivot_metrics(replicates, ["replicate"]).groupBy("metric").agg(
        F.percentile("value", F.lit(0.025)).alias("ci_low"),
        F.percentile("value", F.lit(0.975)).alias("ci_high"),
        F.count(F.lit(1)).cast("int").alias("bootstrap_samples"),
    )
    one = scores.withColumn("_all", F.lit("all"))
    point = unpivot_metrics(
        settle(metrics(one, ["_all"], threshold, probability, target)), ["_all"]
    )
    return point.select("metric", F.col("value").alias("point")).join(spread, "metric")


def calibration(scores: DataFrame, bins: int, probability: str = "probability",
                target: str = "target") -> DataFrame:
    """Mean predicted and observed rate in quantile bins; empty bins do not occur.

    The bin is the number of inner quantile edges strictly below the score, so ties stay
    together.
    """
    probs = [i / bins for i in range(bins + 1)]
    edges = [r["quantile"] for r in
             order.quantiles(scores, probability, probs).orderBy("prob").collect()]
    inner = small_table(scores.sparkSession, [(edges[1:-1],)], "_e array<double>")
    rows = order.locate(order.attach(scores, inner, []), "_e", probability, "bin", bins - 1)
    return rows.groupBy("bin").agg(
        F.avg(probability).alias("mean_predicted"),
        F.avg(target).alias("observed_rate"),
        F.count(F.lit(1)).alias("rows"),
    )
