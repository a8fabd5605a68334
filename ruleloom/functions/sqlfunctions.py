"""Functions for formulas written in SQL: Spark puts their bodies into the plan, so no Python worker is started."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..plans.sqltext import quote

_NAME = re.compile(r"[A-Za-z_]\w*")


def define(spark: SparkSession, name: str, parameters: dict[str, str], returns: str, body: str) -> str:
    """Make ``name(parameters)`` callable in the formulas of this session, in place of an earlier function of that name.

    ``parameters`` are names and types in order, ``body`` is a SQL expression of them.  Arguments are cast to the types.  Returns the name.
    """
    for given in (name, *parameters):
        if not _NAME.fullmatch(given):
            raise ValueError(f"{given!r} is not a plain name")
    listed = ", ".join(f"{quote(p)} {kind}" for p, kind in parameters.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {quote(name)}({listed}) RETURNS {returns} RETURN {body}")
    return name
