"""The registry of queries: a name, a plan and, where SQL can express it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_plans: dict[str, Query] = {}
_sql: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under ``name``."""

    def add(plan: Query) -> Query:
        if name in _plans:
            raise ValueError(f"two queries are named {name}")
        _plans[name] = plan
        if sql:
            _sql[name] = sql
        return plan

    return add


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already, for queries over its result."""
    return _sql[name]


def _load() -> None:
    from tallyforge import plans  # noqa: F401  its modules register what they define


def queries() -> dict[str, Query]:
    _load()
    return dict(_plans)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _plans["attention_signals"](spark, sf_dir)
