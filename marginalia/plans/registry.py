"""Register of queries: each takes (spark, folder of the given tables) and has, where SQL can say it, an oracle."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans.views import with_views
from marginalia.session import ship_code, tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(ship_code(tune(spark)), sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def load_all() -> None:
    """Imports the modules that register queries."""
    from marginalia.plans import conversing, curating, evaluating, landing, retrieving, texts  # noqa: F401
