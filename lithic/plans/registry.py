"""Collects named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    import importlib
    import pkgutil

    import lithic.plans as plans

    for mod in pkgutil.iter_modules(plans.__path__):
        if mod.name.startswith("catalog_"):
            importlib.import_module(f"lithic.plans.{mod.name}")
