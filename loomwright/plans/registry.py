"""The library's queries by name, each with SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_MODULES = ("curation", "selection", "measures", "checks", "texts", "relations", "records", "documents", "builds", "storage")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        import_module(f"loomwright.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    _load()
    return _queries["curation_flow"](spark, d)
