"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curioshelf.plans.views import Views, for_duckdb
from curioshelf.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query over :class:`Views` under ``key``, with its oracle.  The session gets the
    settings that the operators are written for."""

    def register(build: Callable[[Views], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: build(Views(tune(spark), sf_dir))
        if sql is not None:
            ORACLES[key] = for_duckdb(sql)
        return build

    return register
