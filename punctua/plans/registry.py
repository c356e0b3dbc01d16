"""Name -> (query, oracle SQL) table, filled by the modules below."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame under ``name``."""

    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add
