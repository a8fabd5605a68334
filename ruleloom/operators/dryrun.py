"""Dry runs: what every rule does to sample records, without touching them."""

from __future__ import annotations

import json
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import RuleFile, Step
from ..plans.audit import result_sql
from ..plans.engine import evaluate
from ..plans.lower import ERROR, NO_NEW_VALUE, NOT_BOOLEAN, ElementGroup, Options, Record, SetResult, StepLowering, Test
from ..plans.scope import path_sql
from ..plans.sqltext import array, ddl, literal, quote, struct
from ..sources.records import align, from_json

TRACE_TYPE = T.StructType(
    [
        T.StructField("step", T.StringType()),
        T.StructField("rule_no", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def trace(
    df: DataFrame,
    rules: RuleFile,
    keys: list[str],
    *,
    step: int | None = None,
    nested_scope: str = "record",
    qualify_names: bool = False,
) -> DataFrame:
    """One row per record and test, and per record and test set.

    ``input`` is the tested value before the step, ``output`` the value the test
    would leave, ``result`` is NULL where a test was not reached.  A condition
    that is neither true nor false, a runtime error and a substitute that fails
    give FAIL and an error text; a failed substitute leaves the value.  With ``step``
    only that step (counted from 0) runs, on the record as given.
    """
    if step is not None:
        rules = rules.only_step(step)
    options = Options("permissive", nested_scope, qualify_names, any_type=True)
    numbers = count(1)
    keyed = df.select(*[F.col(quote(k)).alias(f"__key_{k}") for k in keys], "*")

    def observe(lowering: StepLowering) -> str:
        return _StepTrace(lowering, numbers).rows(lowering.record)

    done = evaluate(keyed, rules, options, observe=observe)
    traces = [quote(s.prefix + "observed") for s in done.steps] or ["array()"]
    every = f"concat({', '.join(traces)})" if len(traces) > 1 else traces[0]
    rows = done.frame.select(
        *[F.col(f"__key_{k}").alias(k) for k in keys],
        F.explode_outer(F.expr(f"CAST({every} AS ARRAY<{ddl(TRACE_TYPE)}>)")).alias("__row"),
    )
    return rows.where("__row IS NOT NULL").select(*[F.col(quote(k)) for k in keys], "__row.*")


def sample_record(spark: SparkSession, values: dict, schema: T.StructType) -> DataFrame:
    """One record of the given type from plain values, for a dry run; ``"3"`` will do for a number."""
    text = spark.createDataFrame([(json.dumps(values, default=str),)], "payload string")
    return align(from_json(text, "payload", _as_text(schema)), schema)


def _as_text(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_as_text(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(T.StringType(), _as_text(dtype.valueType))
    return T.StringType()


class _StepTrace:
    def __init__(self, lowering: StepLowering, numbers):
        self.lowering, self.numbers = lowering, numbers
        self.step: Step = lowering.step

    def rows(self, record: Record) -> str:
        """SQL text of the array of trace rows of one record."""
        parts = []
        for group in record.groups:
            if isinstance(group, ElementGroup):
                inner = f"CASE WHEN {group.body.codes_ref} IS NOT NULL THEN {self.rows(group.body)} ELSE {self._none()} END"
                bound = f"transform(array(get({group.ref}, {group.index})), {group.body.codes_ref} -> {inner})"
                every = f"transform({group.source.ref}, ({group.element}, {group.index}) -> get({bound}, 0))"
                parts.append(f"coalesce(flatten({every}), {self._none()})")
            else:
                parts.append(array([self._test(t) for t in group.tests if not t.marks_set]))
        if record.sets:
            parts.append(array([self._set(s) for s in record.sets]))
        if not parts:
            return self._none()
        return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"

    def _test(self, test: Test) -> str:
        code, value = test.read(), self._value(test)
        output = value
        if test.rule.substitute is not None:
            dtype = test.container.dtype[test.rule.field].dataType
            new = self._text(self.lowering.new_value(test), dtype)
            output = f"CASE WHEN {code} = {test.code_if_false} THEN {new} ELSE {value} END"
        error = literal(NOT_BOOLEAN)
        if test.rule.substitute is not None and test.condition is not None:
            error = f"CASE WHEN ({test.condition}) IS NULL THEN {error} ELSE {literal(NO_NEW_VALUE)} END"
        error = f"CASE WHEN {code} = {ERROR} THEN {error} END"
        return self._row("test", test.name, test.path, value, output, code, error)

    def _set(self, found: SetResult) -> str:
        value = self._value(found)
        return self._row("set", found.name, found.path, value, value, found.sql, self._null())

    def _value(self, test: Test | SetResult) -> str:
        name = test.rule.field
        if name is None or name not in test.container.names():
            return self._null()
        return self._text(test.container.read(name), test.container.dtype[name].dataType)

    @staticmethod
    def _text(sql: str, dtype: T.DataType) -> str:
        nested = isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))
        return f"to_json({sql})" if nested else f"CAST({sql} AS STRING)"

    def _row(self, kind, name, path, value, output, code, error) -> str:
        return struct(
            {
                "step": literal(self.step.name),
                "rule_no": str(next(self.numbers)),
                "kind": literal(kind),
                "rule": literal(name),
                "text": path_sql(path),
                "input": value,
                "output": output,
                "result": result_sql(code),
                "error": error,
            }
        )

    @staticmethod
    def _null() -> str:
        return "CAST(NULL AS STRING)"

    @staticmethod
    def _none() -> str:
        return f"CAST(array() AS ARRAY<{ddl(TRACE_TYPE)}>)"
