"""End-to-end runs: validate, run (benchmark and selection), tune."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctua.operators import (
    evaluate,
    integrity,
    learners,
    order,
    prepare,
    selection,
    split,
    tune,
)
from punctua.session import stage
from punctua.sinks import write_csv, write_predictions, write_report, write_rows


@dataclass(frozen=True)
class Settings:
    """Arguments of a run.

    Fixed values: the defaults are the published configuration.
    """

    seed: int = 42
    rules: prepare.Rules = prepare.Rules()
    expected: dict[str, float] = field(default_factory=dict)
    test_size: float = 0.20
    train_end: int = 2023
    test_start: int = 2024
    names: tuple[str, ...] = tuple(learners.NAMES)
    selected: str = "stacking"
    save_all: bool = False
    fast: bool = False
    stack_folds: int = 5
    threshold: float = 0.5
    bins: int = 10
    samples: int = 100
    temporal: bool = True
    penalty: float = 2000.0
    capacity: float = 0.60
    value_low: int = 1000
    value_high: int = 5000
    mandatory_fraction: float = 0.05
    group_fraction: float = 0.40
    penalties: tuple[float, ...] = (1000.0, 2000.0, 3000.0, 4000.0)
    capacities: tuple[float, ...] = (0.40, 0.50, 0.60, 0.70, 0.80)

    def as_dict(self) -> dict:
        return {k: str(v) for k, v in self.__dict__.items()}


def validate(raw: DataFrame, settings: Settings) -> DataFrame:
    """Observed against expected figures of a raw table."""
    prepare.check(raw, settings.rules)
    return prepare.validation_report(
        prepare.summarize(raw, settings.rules), settings.expected
    )


def _prepared(raw: DataFrame, settings: Settings, out: str) -> DataFrame:
    """Prepared rows with ``unit_id``, written by year so that later scans prune."""
    key = ["year", "month", "carrier", "airport"]
    rows = stage(prepare.prepare(raw, settings.rules), "prepared")
    # Rows of one key are told apart by their counts; rows equal in those are interchangeable.
    numbered = order.dense_position(rows, [*key, "arr_flights", "arr_del15"], "unit_id")
    write_rows(numbered, f"{out}/prepared", ["year"])
    return raw.sparkSession.read.parquet(f"{out}/prepared")


def select_units(scored: DataFrame, settings: Settings, out: str) -> DataFrame:
    """Policies, optima, scenario grid and the decision table of scored test rows."""
    rows = stage(selection.commercial_values(
        scored, settings.value_low, settings.value_high, f"value{settings.seed}"), "valued")
    evaluate.require_probabilities(rows)
    marked = stage(selection.compare(
        rows, settings.penalty, settings.capacity, f"random{settings.seed}", "carrier",
        settings.group_fraction, settings.mandatory_fraction, f"mand{settings.seed}"), "marked")
    table = selection.comparison_table(marked, settings.penalty)
    grid = selection.scenarios(rows, list(settings.penalties), list(settings.capacities))
    write_csv(table, f"{out}_optimization_strategies")
    write_csv(grid, f"{out}_scenarios")
    names = selection.POLICIES + selection.OPTIMA
    wide = selection.decisions(
        marked, ["unit_id", "value", "probability", "target", "carrier", "airport"], names)
    write_csv(wide, f"{out}_optimization_decisions", compress=True)
    return table


def _fit(name: str, train: DataFrame, settings: Settings) -> learners.Scorer:
    params = learners.defaults(name, settings.fast)
    if name == "stacking":
        params["folds"] = settings.stack_folds
    return learners.fit(name, train, params, settings.seed)


def _wide(scores: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row per test unit with a probability column for each model."""
    return scores.groupBy("unit_id", "target").pivot("model", list(names)).agg(
        F.first("probability"))


def run(spark: SparkSession, raw: DataFrame, settings: Settings, out: str) -> str:
    """Benchmark of all models, calibration, selection and the temporal arm, below ``out``."""
    unknown = sorted(set(settings.names) - set(learners.NAMES))
    if unknown:
        raise ValueError(f"Unknown models {unknown}: known are {learners.NAMES}.")
    if settings.selected not in settings.names:
        raise ValueError("The selected model must be one of the fitted ones.")
    with integrity.RunRecord(spark, f"{out}/runs", "run", settings.as_dict()) as record:
        here = f"{out}/{record.run_id}"
        rows = _prepared(raw, settings, here)
        _expected(raw, settings, f"{here}/validation")
        parts = split.random_split(rows, settings.test_size, f"split{settings.seed}", "unit_id")
        parts = stage(split.balance(parts, f"under{settings.seed}", "unit_id"), "parts")
        write_report(prepare.split_summary(parts), f"{here}/random_split_summary")
        columns = ["unit_id", *prepare.FEATURES, "target"]
        train = stage(parts.where("part = 'train' and kept").select(columns), "train")
        test = stage(parts.where("part = 'test'").select(columns), "test")
        for name in settings.names:
            model = _fit(name, train, settings)
            write_predictions(model.score(test).select("unit_id", "target", "probability"),
                              f"{here}/predictions", name)
            if settings.save_all or name == settings.selected:
                learners.save(spark, model, f"{here}/model_{name}")
        scores = spark.read.parquet(f"{here}/predictions")
        write_csv(_wide(scores, settings.names), f"{here}/test_predictions", compress=True)
        table = evaluate.metrics(scores, ["model"], settings.threshold)
        write_csv(table.orderBy(F.desc("roc_auc")).coalesce(1), f"{here}/model_metrics")
        chosen = scores.where(F.col("model") == settings.selected).drop("model", "target")
        write_csv(evaluate.calibration(chosen.join(test, "unit_id"), settings.bins),
                  f"{here}/calibration")
        select_units(chosen.join(test, "unit_id"), settings, f"{here}/random_split")
        if settings.temporal:
            _temporal(rows, settings, here)
    return here


def _temporal(rows: DataFrame, settings: Settings, here: str, fit=None) -> None:
    parts = split.temporal_split(rows, settings.train_end, settings.test_start)
    split.require_parts(parts)
    parts = stage(split.balance(parts, f"under{settings.seed}", "unit_id"), "temporal")
    columns = ["unit_id", *prepare.FEATURES, "target"]
    train = stage(parts.where("part = 'train' and kept").select(columns), "train")
    test = stage(parts.where("part = 'test'").select(columns), "test")
    model = fit(train) if fit else _fit(settings.selected, train, settings)
    learners.save(rows.sparkSession, model, f"{here}/temporal_model_{settings.selected}")
    scored = stage(model.score(test), "scored")
    write_predictions(scored, f"{here}/temporal_predictions", settings.selected)
    write_csv(evaluate.bootstrap_intervals(
        scored, "unit_id", settings.samples, f"boot{settings.seed}", settings.threshold),
        f"{here}/temporal_metrics")
    select_units(scored, settings, f"{here}/temporal_split")


def _expected(raw: DataFrame, settings: Settings, path: str) -> None:
    if settings.expected:
        write_report(prepare.validation_report(
            prepare.summarize(raw, settings.rules), settings.expected), path)


def _tuned_results(rows: DataFrame, test: DataFrame, specs: dict, settings: Settings,
                   protocol: tune.Protocol, predictions: str, here: str) -> None:
    """What follows the test: wide predictions, calibration, selection, the temporal arm."""
    scores = rows.sparkSession.read.parquet(predictions)
    write_csv(_wide(scores, protocol.names), f"{here}/test_predictions", compress=True)
    chosen = scores.where(F.col("model") == settings.selected).drop("model", "target")
    scored = chosen.join(test, "unit_id")
    write_csv(evaluate.calibration(scored, settings.bins), f"{here}/calibration")
    select_units(scored, settings, f"{here}/random_split")
    if settings.temporal:
        name = settings.selected
        _temporal(rows, settings, here, lambda train: tune.fit_spec(
            name, train, specs[name], specs, protocol, settings.seed))


def tune_run(spark: SparkSession, raw: DataFrame, settings: Settings, protocol: tune.Protocol,
             out: str, unlock: bool = False) -> dict:
    """Nested CV, final tuning, freeze and, if ``unlock``, the one test evaluation with
    predictions, calibration, selection and the temporal arm of the tuned model.

    ``out`` is the run folder: a second call with the same settings resumes it, and repeats
    nothing once it is finished. The result names the folder of its reports.
    """
    if unlock and settings.selected not in protocol.names:
        raise ValueError("The selected model must be one of the tuned ones.")
    config = {"settings": settings.as_dict(), "protocol": protocol.as_dict()}
    seen = integrity.read_table(spark, f"{out}/config")
    digest = integrity.parameters_hash(config)
    if seen is None:
        write_rows(spark.createDataFrame([(digest,)], "config_sha256 string").coalesce(1),
                   f"{out}/config")
    elif seen.first()["config_sha256"] != digest:
        raise ValueError("The run has been started with another configuration.")
    with integrity.RunRecord(spark, f"{out}/runs", "tune", config) as record:
        here = f"{out}/reports-{record.run_id}"  # of this attempt; a broken-off one stays aside
        rows = integrity.read_table(spark, f"{out}/prepared")
        rows = _prepared(raw, settings, out) if rows is None else rows
        parts = split.random_split(rows, settings.test_size, f"split{settings.seed}", "unit_id")
        parts = stage(split.balance(parts, f"under{settings.seed}", "unit_id"), "parts")
        columns = ["unit_id", *prepare.FEATURES, "target"]
        train = parts.where("part = 'train' and kept").select(columns)
        train = stage(split.subsample(train, protocol.sample_rows, f"sample{protocol.seed}",
                                      "unit_id"), "train")
        test = stage(parts.where("part = 'test'").select(columns), "test")
        outer = tune.nested_cv(train, protocol, f"{out}/checkpoints")
        specs = tune.final_tuning(train, protocol, f"{out}/checkpoints")
        test_hash = integrity.ordered_hash(test, "unit_id").first()["sha256"]
        integrity.freeze(spark, f"{out}/freeze", specs, test_hash, not unlock)
        result = {"outer": outer, "summary": tune.nested_summary(outer), "parameters": specs}
        if unlock:
            result["test"] = tune.evaluate_frozen(
                train, test, specs, protocol, f"{out}/checkpoints", f"{out}/predictions",
                f"{out}/freeze", not unlock)
            done = integrity.read_table(spark, f"{out}/finished")
            if done is None:
                _expected(raw, settings, f"{here}/validation")
                write_report(prepare.split_summary(parts), f"{here}/random_split_summary")
                _tuned_results(rows, test, specs, settings, protocol, f"{out}/predictions", here)
                marker = spark.createDataFrame([(here,)], "reports string")
                write_rows(marker.coalesce(1), f"{out}/finished")
            result["reports"] = here if done is None else done.first()["reports"]
    return result
