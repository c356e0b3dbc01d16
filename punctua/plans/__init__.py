"""Queries on the given tables and the end-to-end runs."""
from punctua.plans import basic, decisions, growing, learned  # noqa: F401
from punctua.plans.registry import ORACLES, QUERIES  # noqa: F401
