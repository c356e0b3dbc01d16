"""Fitted models on disk (K6): encodings and tables as Parquet, Spark models, numbers as JSON.

A learner keeps what it fitted as a ``State``; its score function is made from the state alone,
so a loaded model scores exactly as the fitted one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import classification, regression
from pyspark.sql import DataFrame, SparkSession

from punctua.operators import features
from punctua.session import small_table


@dataclass(frozen=True)
class State:
    """What a fitted model is made of; ``parts`` are models inside a model."""

    name: str
    numbers: dict = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    models: dict = field(default_factory=dict)
    parts: dict[str, State] = field(default_factory=dict)


def of_ordinal(encoding: features.Ordinal) -> tuple[dict, dict[str, DataFrame]]:
    """(numbers, tables) of an ordinal encoding."""
    return {"fill": encoding.fill, "scale": encoding.scale}, dict(encoding.codes)


def of_one_hot(encoding: features.OneHot) -> tuple[dict, dict[str, DataFrame]]:
    return ({"fill": encoding.fill, "scale": encoding.scale, "widths": encoding.widths},
            dict(encoding.slots))


def _scale(numbers: dict):
    scale = numbers.get("scale")
    return None if scale is None else {c: tuple(v) for c, v in scale.items()}


def ordinal(state: State) -> features.Ordinal:
    codes = {c: state.tables[c] for c in features.CATEGORICAL}
    return features.Ordinal(codes, state.numbers["fill"], _scale(state.numbers))


def one_hot(state: State) -> features.OneHot:
    slots = {c: state.tables[c] for c in features.CATEGORICAL}
    return features.OneHot(slots, state.numbers["widths"], state.numbers["fill"],
                           _scale(state.numbers))


def save(spark: SparkSession, state: State, path: str) -> None:
    """Write a model into a new folder; an existing one is an error. ``about`` comes last."""
    for name, table in state.tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/tables/{name}")
    for name, model in state.models.items():
        model.write().save(f"{path}/models/{name}")
    for name, part in state.parts.items():
        save(spark, part, f"{path}/parts/{name}")
    about = json.dumps({
        "name": state.name, "numbers": state.numbers, "tables": list(state.tables),
        "models": {k: type(m).__name__ for k, m in state.models.items()},
        "parts": list(state.parts),
    })
    small_table(spark, [(about,)], "about string").coalesce(1).write.mode(
        "errorifexists").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> State:
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    return State(
        about["name"], about["numbers"],
        {t: spark.read.parquet(f"{path}/tables/{t}") for t in about["tables"]},
        {k: getattr(classification, kind, getattr(regression, kind, None)).load(
            f"{path}/models/{k}") for k, kind in about["models"].items()},
        {p: load(spark, f"{path}/parts/{p}") for p in about["parts"]},
    )
