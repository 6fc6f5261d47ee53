"""The registered queries: each runs an operator over whole fixture tables.

A query may carry SQL that gives the same rows; `with_views` adds the views the
SQL reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelode.plans.views import Fixture, with_views

_QUERIES: dict[str, Callable[[Fixture], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Fixture], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = build
        if sql is not None:
            _SQL[name] = with_views(sql)
        return build

    return register


def _load() -> None:
    from sitelode.plans import catalog_set, content_set, jobs_set, metrics_set, runs_set  # noqa: F401


def _bind(build: Callable[[Fixture], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(Fixture(spark, folder))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _bind(build) for name, build in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
