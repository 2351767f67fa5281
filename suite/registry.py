"""Registry of the queries: name, inventory ids, function and SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(*ids: str, sql: str | None = None, name: str | None = None):
    """Registers a query under the name of its function."""

    def register(fn: QueryFn) -> QueryFn:
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = Query(key, ids, fn, sql)
        return fn

    return register
