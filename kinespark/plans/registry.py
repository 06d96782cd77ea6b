"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.plans.fixtures import with_views
from kinespark.session import small_parts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB twin over the fixture ``views``."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            small_parts(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql
        return fn

    return wrap


def place(names: Sequence[str], c: str | Column) -> Column:
    """Place of a name in a list, from 1, for results keyed by whole numbers."""
    return F.array_position(F.array(*[F.lit(n) for n in names]), c).cast("long")


def sql_place(names: Sequence[str], c: str) -> str:
    return f"list_position([{', '.join(repr(n) for n in names)}], {c})::BIGINT"


def r6(c: str | Column, name: str | None = None) -> Column:
    """Round to 6 decimals for comparison; negative zero becomes zero."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 6) + F.lit(0.0)
    return out.alias(name or (c if isinstance(c, str) else "value"))
