"""Applying a rule file to a DataFrame.

The work is a chain of narrow projections: no shuffle, no Python worker, the
same for a batch and a streaming frame.  Per step

1. the stop positions of test sets (only if the step has such sets),
2. the codes of all tests,
3. the changed columns (only if the step has substitutes),

and, once at the end, the audit structure from the codes of all steps.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import RuleFile
from ..session import advise
from .audit import (
    AUDIT,
    AUDIT_TYPE,
    DETAIL_LEVELS,
    DETAILS,
    details_sql,
    error_names_sql,
    no_details,
    old_verdict_sql,
    verdict_sql,
)
from .lower import Options, StepLowering
from .sqltext import ddl, literal, quote, struct

CHANGE_TYPE = "__change_type"
# Delete, eXterminate and Truncate rows are not validated.
SKIPPED_CHANGE_TYPES = ("D", "X", "T")
VERDICTS = ("details", "sets")


@dataclass
class Evaluated:
    """A frame whose values are final and which still carries the codes of every step."""

    frame: DataFrame
    columns: list[str]
    steps: list[StepLowering]
    gate: str | None

    @property
    def records(self):
        return [s.record for s in self.steps]


def gate_sql(schema: T.StructType, extra: str | None = None) -> str | None:
    """Which rows the rules apply to, None for all of them."""
    parts = []
    if CHANGE_TYPE in schema.fieldNames():
        skipped = ", ".join(literal(c) for c in SKIPPED_CHANGE_TYPES)
        parts.append(f"coalesce(CAST({quote(CHANGE_TYPE)} AS STRING), '') NOT IN ({skipped})")
    if extra:
        parts.append(f"coalesce({extra}, false)")
    return " AND ".join(f"({p})" for p in parts) or None


@contextmanager
def errors_become_null(spark, wanted: bool):
    """Within it expressions are analysed so that a failing division, cast or index gives NULL instead of stopping the job.

    The choice is fixed when an expression is analysed, so the session's setting is back before anything runs.
    """
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    if wanted and before != "false":
        spark.conf.set(key, "false")
    try:
        yield
    finally:
        if spark.conf.get(key) != before:
            spark.conf.set(key, before)


def evaluate(
    df: DataFrame,
    rules: RuleFile,
    options: Options = Options(),
    *,
    only_rows: str | None = None,
    prefix: str = "__rl",
    observe: Callable[[StepLowering], str] | None = None,
) -> Evaluated:
    """Run every step; codes stay in extra columns, substitutes are applied.

    ``observe`` may give SQL text evaluated in each step on the values before
    its substitutes; the result stays in the column ``observed`` of the step.
    """
    with errors_become_null(df.sparkSession, options.permissive):
        return _evaluate(df, rules, options, only_rows, prefix, observe)


def _evaluate(df, rules, options, only_rows, prefix, observe) -> Evaluated:
    columns = df.columns
    gate = gate_sql(df.schema, only_rows)
    frame, gate_ref = df, None
    if gate:
        gate_ref = quote(f"{prefix}_gate")
        frame = frame.select("*", F.expr(gate).alias(f"{prefix}_gate"))
    schema = T.StructType([f for f in df.schema.fields if f.name != AUDIT])
    steps = []
    for number, step in enumerate(rules.steps, 1):
        lowering = StepLowering(step, schema, options, f"{prefix}{number}_")
        steps.append(lowering)
        frame = _run_step(frame, lowering, gate_ref, observe)
    advise(df.sparkSession, sum(1 for s in steps for _ in s.record.tests()))
    return Evaluated(frame, columns, steps, gate_ref)


def _run_step(frame: DataFrame, lowering: StepLowering, gate: str | None, observe) -> DataFrame:
    record, prefix = lowering.record, lowering.prefix

    def gated(sql: str):
        return F.expr(f"CASE WHEN {gate} THEN {sql} END" if gate else sql)

    changes = lowering.changes()
    helpers = []
    if lowering.formula_columns:
        frame = frame.select("*", *[c.alias(n) for n, c in lowering.formula_columns.items()])
        helpers += lowering.formula_columns
    for level in record.decisions:
        frame = frame.select("*", *[gated(d.sql).alias(prefix + d.name) for d in level])
        helpers += [prefix + d.name for d in level]
    if record.groups:
        codes = [gated(g.codes()).alias(f"{prefix}s{n}") for n, g in enumerate(record.groups)]
        frame = frame.select("*", *codes)
    if observe:
        frame = frame.select("*", gated(observe(lowering)).alias(prefix + "observed"))
    if changes or helpers:
        kept = [c for c in frame.columns if c not in helpers]
        frame = frame.select([F.expr(changes[c]).alias(c) if c in changes else F.col(quote(c)) for c in kept])
    return frame


def validate(
    df: DataFrame,
    rules: RuleFile,
    *,
    mode: str = "strict",
    verdict: str = "details",
    details: str = "all",
    nested_scope: str = "record",
    qualify_names: bool = False,
    error_column: str | None = None,
    only_rows: str | None = None,
    prefix: str = "__rl",
) -> DataFrame:
    """Validate and cleanse every record of ``df`` and add or extend ``__audit``.

    ``mode``           ``strict``: a condition that is neither true nor false fails the
                       query, and so does a runtime error; ``permissive``: both count as FAIL, and
                       a substitute that fails or does not fit its field leaves the old value
                       and counts as FAIL.  Formulas follow Spark's non-ANSI rules then: what
                       would be an error is NULL (sums beyond a type's range wrap around).
                       A NULL substitute is taken as meant only if its formula names NULL or nullif.
    ``verdict``        ``details``: the lowest single test decides; ``sets``: the lowest
                       result of the outermost tests and test sets does.
    ``details``        ``all``, ``not_passed`` or ``none``; the verdict is the same.
    ``nested_scope``   container of the tests in a nested record: that ``record``, or the
                       ``enclosing`` one (paths and substitutes then go one level up).
    ``qualify_names``  ``set/rule`` instead of the plain rule name.
    ``error_column``   with ``permissive``: a further column naming the tests that had
                       no true/false result.
    ``only_rows``      SQL predicate; other rows pass through unchanged.
    """
    if verdict not in VERDICTS:
        raise ValueError(f"verdict must be one of {VERDICTS}, not {verdict!r}")
    if details not in DETAIL_LEVELS:
        raise ValueError(f"details must be one of {DETAIL_LEVELS}, not {details!r}")
    options = Options(mode, nested_scope, qualify_names)
    if error_column and not options.permissive:
        raise ValueError("error_column needs mode='permissive'")
    if error_column in df.columns or error_column == AUDIT:
        raise ValueError(f"error_column {error_column!r} is a column already")
    if not rules.steps:
        return df
    done = evaluate(df, rules, options, only_rows=only_rows, prefix=prefix)
    has_audit = AUDIT in df.columns

    codes = [old_verdict_sql()] if has_audit else []
    rows = [f"coalesce({quote(AUDIT)}.{quote(DETAILS)}, {no_details()})"] if has_audit else []
    for record in done.records:
        worst = record.worst() if verdict == "details" else record.worst_of_sets()
        codes += [worst] if worst else []
        found = details_sql(record, details, options.permissive) if details != "none" else None
        rows += [found] if found else []
    all_rows = no_details() if not rows else rows[0] if len(rows) == 1 else f"concat({', '.join(rows)})"
    audit = struct({"__transformresult": verdict_sql(codes), DETAILS: all_rows})
    audit_type = ddl(AUDIT_TYPE)
    if done.gate:
        kept = f"CAST({quote(AUDIT)} AS {audit_type})" if has_audit else f"CAST(NULL AS {audit_type})"
        audit = f"CASE WHEN {done.gate} THEN {audit} ELSE {kept} END"
    # no cast around it: whoever reads the verdict alone then never builds the details
    audit_column = F.expr(audit).alias(AUDIT)

    selected = [audit_column if c == AUDIT else F.col(quote(c)) for c in done.columns]
    if not has_audit:
        selected.append(audit_column)
    if error_column:
        names = [error_names_sql(r) for r in done.records]
        found = names[0] if len(names) == 1 else f"concat({', '.join(names)})"
        selected.append(F.expr(f"coalesce({found}, CAST(array() AS ARRAY<STRING>))").alias(error_column))
    return done.frame.select(selected)
