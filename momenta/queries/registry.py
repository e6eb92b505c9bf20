"""The registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL with the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Modules of this package that register queries when imported.
MODULES = ("words", "tables", "files", "numbers", "estimates", "structured")


def query(name: str, sql: str | None = None):
    """Registers the decorated function under name, with the SQL of the same rows if there is one."""

    def register(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"momenta.queries.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
