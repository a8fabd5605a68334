"""Figures over audit results, samples and dry runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import ArrayOf, RuleFile, SingleTest, Step, TestSet, validate
from ruleloom.operators.dryrun import trace
from ruleloom.operators.reports import (
    failed, passed, quality_by_field, rule_summary, stored_rule_summary, verdict_trend,
)
from ruleloom.operators.sampling import sample_payload, sample_recent, sample_within

from .arrays import _line
from .cleansing import lines_of_documents
from .registry import query, table, union
from .singles import ORDER_RULES, ORDER_RULES_SQL


@query("dq_rule_summary", f"SELECT rule, result, CAST(count(*) AS BIGINT) AS tests FROM ({ORDER_RULES_SQL}) GROUP BY rule, result")
def dq_rule_summary(spark, folder):
    return rule_summary(table(spark, folder, "orders"), ORDER_RULES)


@query("dq_stored_summary", f"SELECT rule, result, CAST(count(*) AS BIGINT) AS tests FROM ({ORDER_RULES_SQL}) GROUP BY rule, result")
def dq_stored_summary(spark, folder):
    return stored_rule_summary(validate(table(spark, folder, "orders"), ORDER_RULES))


_DOCUMENT_TESTS = union(
    _line("not too long", "length(line) <= 300", "line", "WARN"),
    _line("ends well", "length(line) = 0 OR line LIKE '%.'", None, "WARN"),
)


@query(
    "dq_quality_by_field",
    f"""SELECT field, CAST(count(*) AS BIGINT) AS tests, CAST(sum(quality) AS DOUBLE) / count(*) AS quality
FROM (SELECT regexp_replace(text, '[0-9]+', '', 'g') AS field, quality FROM ({_DOCUMENT_TESTS})) GROUP BY field""",
)
def dq_quality_by_field(spark, folder):
    rules = RuleFile.of("documents", ArrayOf("lines", [
        SingleTest("line", "not too long", "{size} <= 300", "WARN"),
        SingleTest(None, "ends well", "{size} = 0 OR {line} LIKE '%.'", "WARN"),
    ]))
    return quality_by_field(lines_of_documents(spark, folder), rules)


@query(
    "dq_quality_by_source",
    f"""SELECT o_orderstatus, field, CAST(count(*) AS BIGINT) AS tests, CAST(sum(quality) AS DOUBLE) / count(*) AS quality
FROM (SELECT o.o_orderstatus, t.text AS field, t.quality FROM ({ORDER_RULES_SQL}) t JOIN orders o ON t.o_orderkey = o.o_orderkey)
GROUP BY o_orderstatus, field""",
)
def dq_quality_by_source(spark, folder):
    return quality_by_field(table(spark, folder, "orders"), ORDER_RULES, by=["o_orderstatus"])


@query("dq_split_clean", "SELECT * FROM orders WHERE o_totalprice > 0 AND o_orderpriority <> '4-NOT SPECIFIED'")
def dq_split_clean(spark, folder):
    return passed(validate(table(spark, folder, "orders"), ORDER_RULES, details="none")).drop("__audit")


@query("dq_split_failed", "SELECT * FROM orders WHERE NOT (o_totalprice > 0 AND o_orderpriority <> '4-NOT SPECIFIED')")
def dq_split_failed(spark, folder):
    return failed(validate(table(spark, folder, "orders"), ORDER_RULES, details="none")).drop("__audit")


EVENT_RULES = RuleFile.of(
    "events",
    SingleTest("value", "not small", "value > 10", "WARN"),
    SingleTest("event_type", "no errors", "event_type <> 'error'"),
)
EVENT_VERDICT = "CASE WHEN event_type = 'error' THEN 'FAIL' WHEN value <= 10 THEN 'WARN' ELSE 'PASS' END"


@query(
    "dq_verdict_by_hour",
    f"""SELECT date_trunc('hour', ts) AS window_start, {EVENT_VERDICT} AS verdict, CAST(count(*) AS BIGINT) AS records
FROM events GROUP BY 1, 2""",
)
def dq_verdict_by_hour(spark, folder):
    return verdict_trend(validate(table(spark, folder, "events"), EVENT_RULES, details="none"), "ts", "1 hour")


_RECENT = """SELECT event_id, CAST(event_id % 13 AS INTEGER) AS part, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id % 13 ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10"""


def _recent_events(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", F.expr("CAST(event_id % 13 AS INT)").alias("part"), "user_id", "event_type"
    )
    return sample_recent(events, ["part"], "event_id")


@query("sample_recent", f"{_RECENT} ORDER BY r, part LIMIT 100")
def sample_recent_events(spark, folder):
    return _recent_events(spark, folder)


@query("sample_in_time", f"{_RECENT} ORDER BY r, part LIMIT 100")
def sample_in_time(spark, folder):
    """The same sample, one job a partition, with a time limit that is not met here."""
    events = table(spark, folder, "events").select("event_id", F.expr("CAST(event_id % 13 AS INT)").alias("part"), "user_id", "event_type")
    sample = sample_within(events, "part", list(range(13)), "event_id", seconds=600)
    if sample.missing:
        raise TimeoutError(f"partitions {sample.missing} were not read in time")
    return sample.rows


@query(
    "sample_payload",
    f"""SELECT event_id AS sample_offset, 'events' AS sample_topic, part AS sample_partition,
  'partition_' || part || '_offset_' || event_id || '.json' AS filename,
  '{{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}}' AS payload
FROM ({_RECENT} ORDER BY r, part LIMIT 100)""",
)
def sample_payload_events(spark, folder):
    sample = _recent_events(spark, folder).withColumn("topic", F.lit("events"))
    return sample_payload(sample, "topic", "part", "event_id", ["event_id", "user_id", "event_type"])


DRY_RULES = RuleFile(
    "customer",
    (
        Step("cleanse", [
            SingleTest("c_mktsegment", "lower case", "c_mktsegment = lower(c_mktsegment)", "PASS", "lower(c_mktsegment)"),
            SingleTest("c_nationkey", "no result", "nullif(c_nationkey, 3) < 20", "WARN"),
        ]),
        Step("check", [
            TestSet("c_mktsegment", "segment", "until_passes", [
                SingleTest("c_mktsegment", "building", "c_mktsegment = 'building'"),
                SingleTest("c_mktsegment", "machinery", "c_mktsegment = 'machinery'", "WARN"),
            ]),
            SingleTest("c_custkey", "not a condition", "c_custkey + 1"),
        ]),
    ),
)

_NO_RESULT = "the condition gave neither true nor false"


def _trace_row(step, no, kind, rule, text, value, output, result, error="CAST(NULL AS VARCHAR)", source="customer"):
    return (
        f"SELECT c_custkey, '{step}' AS step, CAST({no} AS INTEGER) AS rule_no, '{kind}' AS kind, '{rule}' AS rule,"
        f" '{text}' AS text, {value} AS input, {output} AS output, {result} AS result, {error} AS error FROM {source}"
    )


def _dry_step(first: int, segment: str) -> str:
    b, m = f"{segment} = 'building'", f"{segment} = 'machinery'"
    return union(
        _trace_row("check", first, "test", "building", "c_mktsegment", segment, segment,
                   f"CASE WHEN {b} THEN 'PASS' ELSE 'FAIL' END"),
        _trace_row("check", first + 1, "test", "machinery", "c_mktsegment", segment, segment,
                   f"CASE WHEN {b} THEN NULL WHEN {m} THEN 'PASS' ELSE 'WARN' END"),
        _trace_row("check", first + 2, "test", "not a condition", "c_custkey", "CAST(c_custkey AS VARCHAR)",
                   "CAST(c_custkey AS VARCHAR)", "'FAIL'", f"'{_NO_RESULT}'"),
        _trace_row("check", first + 3, "set", "segment", "c_mktsegment", segment, segment,
                   f"CASE WHEN {b} OR {m} THEN 'PASS' ELSE 'WARN' END"),
    )


@query(
    "dry_run_trace",
    union(
        _trace_row("cleanse", 1, "test", "lower case", "c_mktsegment", "c_mktsegment", "lower(c_mktsegment)", "'PASS'"),
        _trace_row("cleanse", 2, "test", "no result", "c_nationkey", "CAST(c_nationkey AS VARCHAR)",
                   "CAST(c_nationkey AS VARCHAR)",
                   "CASE WHEN c_nationkey = 3 THEN 'FAIL' WHEN c_nationkey < 20 THEN 'PASS' ELSE 'WARN' END",
                   f"CASE WHEN c_nationkey = 3 THEN '{_NO_RESULT}' END"),
        _dry_step(3, "lower(c_mktsegment)"),
    ),
)
def dry_run_trace(spark, folder):
    return trace(table(spark, folder, "customer"), DRY_RULES, ["c_custkey"])


@query("dry_run_step", _dry_step(1, "c_mktsegment"))
def dry_run_step(spark, folder):
    return trace(table(spark, folder, "customer"), DRY_RULES, ["c_custkey"], step=1)


_FAILING = RuleFile.of(
    "customer",
    SingleTest("c_nationkey", "division", "100 / c_nationkey > 5", "WARN"),
    SingleTest("c_name", "cast", "CAST(c_mktsegment AS INT) > 0"),
    SingleTest("c_nationkey", "index", "array(4, 5, 6)[c_nationkey] > 4", "WARN"),
    SingleTest("c_nationkey", "fine", "c_nationkey >= 0"),
)
_ERRORS_SQL = "concat_ws(',', CASE WHEN c_nationkey = 0 THEN 'division' END, 'cast', CASE WHEN c_nationkey > 2 THEN 'index' END)"


@query("permissive_runtime_errors", f"SELECT c_custkey, 'FAIL' AS verdict, {_ERRORS_SQL} AS errors FROM customer")
def permissive_runtime_errors(spark, folder):
    done = validate(table(spark, folder, "customer"), _FAILING, mode="permissive", error_column="errors")
    return done.select("c_custkey", F.col("__audit.__transformresult").alias("verdict"), F.array_join("errors", ",").alias("errors"))


_REPLACING = RuleFile.of(
    "customer",
    SingleTest("c_nationkey", "not a number", "c_nationkey < 20", "WARN", "concat('n', c_name)"),
    SingleTest("c_acctbal", "divided", "c_acctbal >= 0", "WARN", "100 / (c_nationkey - 7)"),
    SingleTest("c_mktsegment", "blanked", "c_mktsegment <> 'FURNITURE'", "WARN", "nullif(c_mktsegment, 'FURNITURE')"),
)
_BAD_NATION, _BAD_BALANCE = "c_nationkey >= 20", "(c_acctbal < 0 AND c_nationkey = 7)"


@query("permissive_bad_substitute", f"""SELECT c_custkey, c_nationkey,
  CASE WHEN c_acctbal < 0 AND c_nationkey <> 7 THEN 100 / (c_nationkey - 7) ELSE c_acctbal END AS c_acctbal,
  nullif(c_mktsegment, 'FURNITURE') AS c_mktsegment,
  CASE WHEN {_BAD_NATION} OR {_BAD_BALANCE} THEN 'FAIL' WHEN c_acctbal < 0 OR c_mktsegment = 'FURNITURE' THEN 'WARN' ELSE 'PASS' END AS verdict,
  concat_ws(',', CASE WHEN {_BAD_NATION} THEN 'not a number' END, CASE WHEN {_BAD_BALANCE} THEN 'divided' END) AS errors FROM customer""")
def permissive_bad_substitute(spark, folder):
    done = validate(table(spark, folder, "customer"), _REPLACING, mode="permissive", error_column="errors")
    return done.select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", F.col("__audit.__transformresult").alias("verdict"),
        F.array_join("errors", ",").alias("errors"),
    )


_NO_VALUE = "the new value could not be made, the old one stays"


@query(
    "dry_run_errors",
    union(
        _trace_row("try", 1, "test", "ratio", "c_nationkey", "CAST(c_nationkey AS VARCHAR)", "CAST(c_nationkey AS VARCHAR)",
                   "CASE WHEN c_nationkey = 0 THEN 'FAIL' WHEN 100 / c_nationkey > 5 THEN 'PASS' ELSE 'WARN' END",
                   f"CASE WHEN c_nationkey = 0 THEN '{_NO_RESULT}' END"),
        _trace_row("try", 2, "test", "renamed", "c_nationkey", "CAST(c_nationkey AS VARCHAR)", "CAST(c_nationkey AS VARCHAR)",
                   "CASE WHEN c_nationkey < 20 THEN 'PASS' ELSE 'FAIL' END", f"CASE WHEN c_nationkey >= 20 THEN '{_NO_VALUE}' END"),
    ),
)
def dry_run_errors(spark, folder):
    rules = RuleFile("customer", (Step("try", [
        SingleTest("c_nationkey", "ratio", "100 / c_nationkey > 5", "WARN"),
        SingleTest("c_nationkey", "renamed", "c_nationkey < 20", "WARN", "concat('n', c_name)"),
    ]),))
    return trace(table(spark, folder, "customer"), rules, ["c_custkey"])
