"""Named queries over the fixture tables and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from engramlake.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "hybrid_search"


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is its statement for another engine, where SQL can express it."""

    def put(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        @wraps(fn)
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def load() -> None:
    """Imports the modules that register queries."""
    from engramlake.plans import graphs, relational, retrieval, scalars, sources, states, statistics  # noqa: F401
