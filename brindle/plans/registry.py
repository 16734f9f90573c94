"""All queries of the engine's own operators, with their SQL oracles side by side."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}
MODULES = ("pages", "texts", "scoring", "api", "graphs", "scripts", "streams", "quality", "surface")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def keep(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _ORACLE[fn.__name__] = sql
        return fn

    return keep


def _load() -> None:
    for m in MODULES:
        import_module(f"brindle.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
