"""Registry of the relational, time-series and audit queries with their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query function, with its SQL twin if there is one. Whatever of it runs in Python finds the package on the executors."""

    def put(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return put
