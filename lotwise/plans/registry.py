"""All queries over the supplied tables, and the SQL that each must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_found: dict[str, tuple[Callable, str | None]] = {}
MODULES = ("groups", "grouped", "joined", "texts", "domain", "streams", "more", "values", "computed", "shapes", "pages", "states")


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder of tables), with SQL that gives the same rows where SQL can."""

    def put(f: Callable) -> Callable:
        if name in _found and _found[name][0].__qualname__ != f.__qualname__:
            raise ValueError(f"two queries are named {name}")
        _found[name] = (f, sql)
        return f

    return put


def _load() -> dict[str, tuple[Callable, str | None]]:
    for m in MODULES:
        importlib.import_module(f"lotwise.plans.{m}")
    return _found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _load().items() if s}
