"""Queries of this subpackage: name, Spark callable over a table folder, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.plans.registry import Query

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Query(fn, sql)
        return fn
    return register
