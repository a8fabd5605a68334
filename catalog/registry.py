"""Registering queries and writing their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.reports import audit_rows, verdict
from ruleloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: function(tune(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flat(df: DataFrame, *keys: str) -> DataFrame:
    """Keys and audit details, one row per executed test."""
    return audit_rows(df, list(keys)).withColumn("quality", F.col("quality").cast("int"))


def verdicts(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, verdict().alias("verdict"))


def quality(result: str) -> str:
    return f"CAST(CASE {result} WHEN 'PASS' THEN 100 WHEN 'WARN' THEN 90 ELSE 0 END AS INTEGER)"


def detail(source: str, keys: str, rule: str, result: str, text: str, where: str = "true") -> str:
    """SQL for the details of one test; ``result`` and ``text`` are SQL expressions."""
    return (
        f"SELECT {keys}, '{rule}' AS rule, result_ AS result, text_ AS text, {quality('result_')} AS quality "
        f"FROM (SELECT *, {result} AS result_, {text} AS text_ FROM {source} WHERE {where})"
    )


def test(source: str, keys: str, rule: str, condition: str, text: str | None, if_false: str = "FAIL",
         where: str = "true") -> str:
    shown = f"'{text}'" if text else "CAST(NULL AS VARCHAR)"
    return detail(source, keys, rule, f"CASE WHEN {condition} THEN 'PASS' ELSE '{if_false}' END", shown, where)


test.__test__ = False


def union(*selects: str) -> str:
    return " UNION ALL ".join(selects)
