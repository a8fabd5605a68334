"""Data-quality figures, from the codes of a run or from stored audits.

The figures from codes never build detail rows: codes are small integers, counted
within each task before anything is shuffled, and names join the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import RuleFile
from ..plans.audit import AUDIT, DETAIL_NAME, DETAIL_QUALITY, DETAIL_TEXT, DETAILS, RESULT, quality_sql, result_sql
from ..plans.engine import evaluate
from ..plans.lower import ERROR, PASS, Options, Record, TestGroup
from ..plans.sqltext import array, literal, quote, struct


def rule_summary(df: DataFrame, rules: RuleFile, by: list[str] | None = None, **options) -> DataFrame:
    """Executed tests per rule and result: ``rule, result, tests``."""
    keys = [F.col(quote(b)) for b in by or []]
    result = F.expr(result_sql("code")).alias("result")
    return _code_counts(df, rules, by or [], options).groupBy(*keys, "rule", result).agg(F.sum("tests").alias("tests"))


def quality_by_field(df: DataFrame, rules: RuleFile, by: list[str] | None = None, **options) -> DataFrame:
    """Average quality per tested field, array elements taken together: ``field, tests, quality``."""
    keys = [F.col(quote(b)) for b in by or []]
    points = F.expr(quality_sql("code")).cast("long") * F.col("tests")
    return (
        _code_counts(df, rules, by or [], options)
        .groupBy(*keys, "field")
        .agg(F.sum("tests").alias("tests"), F.sum(points).alias("points"))
        .select(*keys, "field", "tests", (F.col("points") / F.col("tests")).alias("quality"))
    )


def _code_counts(df: DataFrame, rules: RuleFile, by: list[str], options: dict) -> DataFrame:
    """Rows ``by..., rule, field, code, tests``, some of them still to be added up."""
    done = evaluate(df, rules, Options(**options))
    groups = [g for record in done.records for g in record.groups]
    if all(isinstance(g, TestGroup) for g in groups):
        return _counted_in_place(done.frame, groups, by, options)
    return _counted_by_element(done, by)


# Merging the partial counts of very many tasks is spread over this many rows.
MERGE_WAYS = 64


def _counted_in_place(frame: DataFrame, groups: list[TestGroup], by: list[str], options: dict) -> DataFrame:
    """Counters side by side in one aggregate: no row per test, one row per task to shuffle."""
    permissive = options.get("mode") == "permissive"
    keys = [F.col(quote(b)) for b in by]
    counters, rows, number = [], [], 0
    for g, group in enumerate(groups):
        counters.append(F.expr(f"count({group.ref})").alias(f"ran{g}"))
        for test in group.tests:
            if test.silent:
                continue
            ran, false, error = f"ran{g}", f"false{number}", "0L"
            if test.conditional:
                ran = f"done{number}"
                counters.append(F.expr(f"count({test.read()})").alias(ran))
            counters.append(F.expr(f"count_if({test.read()} = {test.code_if_false})").alias(false))
            if permissive:
                error = f"error{number}"
                counters.append(F.expr(f"count_if({test.read()} = {ERROR})").alias(error))
            names = {"rule": literal(test.name), "field": literal(_field(test.path))}
            counts = {PASS: f"{ran} - {false} - {error}", test.code_if_false: false, ERROR: error}
            rows += [struct({**names, "code": str(code), "tests": n}) for code, n in counts.items() if n != "0L"]
            number += 1
    if not rows:
        rows = [struct({"rule": "''", "field": "''", "code": "0", "tests": "0L"})]
    way = F.expr(f"pmod(spark_partition_id(), {MERGE_WAYS})").alias("__way")
    counted = frame.groupBy(*keys, way).agg(*counters)
    unpivoted = counted.select(*keys, F.explode(F.expr(array(rows))).alias("__c"))
    return unpivoted.select(*keys, "__c.*").where("tests > 0")


def _counted_by_element(done, by: list[str]) -> DataFrame:
    """One small pair per executed test of an element, counted before the shuffle."""
    keys = [F.col(quote(b)) for b in by]
    names: list[tuple[int, str, str | None]] = []
    parts = [p for record in done.records for p in _coded(record, names)]
    every = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    pairs = F.explode_outer(F.expr(f"CAST({every} AS ARRAY<STRUCT<rule_id: INT, code: TINYINT>>)"))
    counted = (
        done.frame.select(*keys, pairs.alias("__c"))
        .select(*keys, "__c.rule_id", "__c.code")
        .where("code IS NOT NULL")
        .groupBy(*keys, "rule_id", "code")
        .agg(F.count(F.lit(1)).alias("tests"))
    )
    # one row per rule, which bounds the broadcast
    known = done.frame.sparkSession.createDataFrame(names, "rule_id int, rule string, field string")
    return counted.join(F.broadcast(known), "rule_id").drop("rule_id")


def _coded(record: Record, names: list) -> list[str]:
    """SQL arrays of (rule id, code) pairs, one per group of tests."""
    parts = []
    for group in record.groups:
        if isinstance(group, TestGroup):
            first = len(names)
            names += [(first + n, t.name, _field(t.path)) for n, t in enumerate(group.tests)]
            silent = [str(n) for n, t in enumerate(group.tests) if t.silent]
            code = f"CASE WHEN n IN ({', '.join(silent)}) THEN NULL ELSE c END" if silent else "c"
            parts.append(f"transform({group.ref}, (c, n) -> {struct({'rule_id': f'CAST({first} + n AS INT)', 'code': code})})")
        else:
            inner = _coded(group.body, names)
            both = inner[0] if len(inner) == 1 else f"concat({', '.join(inner)})"
            empty = "CAST(array() AS ARRAY<STRUCT<rule_id: INT, code: TINYINT>>)"
            parts.append(f"flatten(transform({group.ref}, {group.body.codes_ref} -> coalesce({both}, {empty})))")
    empty = "CAST(array() AS ARRAY<STRUCT<rule_id: INT, code: TINYINT>>)"
    return [f"coalesce({p}, {empty})" for p in parts]


def _field(path: tuple[str, ...]) -> str | None:
    """The path with ``[]`` for every index, e.g. ``addresses[].city``."""
    if not path:
        return None
    return "".join(p[1:-1] for p in path if p.startswith("'"))


def audit_rows(df: DataFrame, keys: list[str], ordinal: str | None = None) -> DataFrame:
    """The stored audit as flat rows: keys, rule, result, text, quality."""
    # A plain explode lets Spark filter on the size of the array first and so
    # evaluate every rule twice; the outer form with a filter behind it does not.
    details = F.col(f"{quote(AUDIT)}.{quote(DETAILS)}")
    key_columns = [F.col(quote(k)) for k in keys]
    if ordinal:
        rows = df.select(*key_columns, F.posexplode_outer(details).alias("__n", "__d"))
        extra = [(F.col("__n") + 1).alias(ordinal)]
    else:
        rows = df.select(*key_columns, F.explode_outer(details).alias("__d"))
        extra = []
    return rows.where(F.col("__d").isNotNull()).select(
        *key_columns,
        *extra,
        F.col("__d").getField(DETAIL_NAME).alias("rule"),
        F.col("__d").getField(RESULT).alias("result"),
        F.col("__d").getField(DETAIL_TEXT).alias("text"),
        F.col("__d").getField(DETAIL_QUALITY).alias("quality"),
    )


def verdict() -> Column:
    """The stored record verdict."""
    return F.col(f"{quote(AUDIT)}.{quote(RESULT)}")


def stored_rule_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``rule_summary`` from the audits already in a table."""
    rows = audit_rows(df, by or [])
    return rows.groupBy(*[F.col(quote(b)) for b in by or []], "rule", "result").agg(F.count(F.lit(1)).alias("tests"))


def stored_quality_by_field(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Average quality per result text of stored audits, indexes of arrays left out."""
    rows = audit_rows(df, by or [])
    field = F.regexp_replace("text", r"\[\d+\]", "[]").alias("field")
    return rows.groupBy(*[F.col(quote(b)) for b in by or []], field).agg(
        F.count(F.lit(1)).alias("tests"), F.avg("quality").alias("quality")
    )


def passed(df: DataFrame, at_worst: str = "WARN") -> DataFrame:
    """Cleansed records: verdict PASS, or also WARN."""
    wanted = ["PASS"] if at_worst == "PASS" else ["PASS", "WARN"]
    return df.where(F.coalesce(verdict(), F.lit("PASS")).isin(wanted))


def failed(df: DataFrame) -> DataFrame:
    """Records with verdict FAIL."""
    return df.where(verdict() == "FAIL")


def write_split(df: DataFrame, path: str, column: str = "verdict", mode: str = "errorifexists") -> None:
    """All records in one write, one folder per verdict, so rules are evaluated once."""
    df.withColumn(column, F.coalesce(verdict(), F.lit("NONE"))).write.mode(mode).partitionBy(column).parquet(path)


def verdict_trend(df: DataFrame, time: str, width: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """Records per time window and verdict; with ``lateness`` ready for a stream in append mode."""
    frame = df
    if lateness:
        # a watermark wants a timestamp with time zone
        frame = df.withColumn(time, F.col(quote(time)).cast("timestamp")).withWatermark(time, lateness)
    counts = frame.groupBy(F.window(F.col(quote(time)), width).alias("w"), verdict().alias("verdict")).agg(
        F.count(F.lit(1)).alias("records")
    )
    return counts.select(F.col("w.start").alias("window_start"), "verdict", "records")


__all__ = [
    "rule_summary", "quality_by_field", "audit_rows", "verdict", "stored_rule_summary",
    "stored_quality_by_field", "passed", "failed", "write_split", "verdict_trend",
]
