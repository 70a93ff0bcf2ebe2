"""The queries of the engine's own operators, and their SQL."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of ``Inputs`` under its name, with the DuckDB SQL for the same rows."""

    def register(f):
        @functools.wraps(f)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            from .views import Inputs

            return f(Inputs(spark, folder))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for name in ("retrieval", "scalars", "maintenance", "through_engine"):
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
