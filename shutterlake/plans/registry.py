"""All queries of the library and their SQL oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import load, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(*tables: str, sql: str | None = None) -> Callable:
    """Register a function of the named tables as a query; ``sql`` is its oracle over the same tables."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[load(spark, sf_dir, t) for t in tables])

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = with_tables(tables, sql)
        return f

    return register


from . import analytics, changes, media_files, regions, relational, scalars  # noqa: E402, F401
