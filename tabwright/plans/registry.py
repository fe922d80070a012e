"""Where queries and their checking SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabwright.operators.dispatch import run_transform
from tabwright.plans.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = with_views(sql)


def transform(source: str, operation: str, **params) -> Query:
    """A query that runs one operation on a view."""
    return lambda spark, sf_dir: run_transform(view(spark, sf_dir, source), operation, params)


def report(source: str, make: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """A query that calls a function on a view."""
    return lambda spark, sf_dir: make(view(spark, sf_dir, source), *args, **kwargs)
