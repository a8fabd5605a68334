"""Registering the operators' queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: function(session(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
