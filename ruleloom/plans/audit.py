"""From codes to the audit structure."""

from __future__ import annotations

from pyspark.sql import types as T

from .lower import ERROR, WAIVED, ElementGroup, Record, Test, TestGroup
from .scope import is_static, path_sql
from .sqltext import array, ddl, greatest, literal, quote, struct

# Fixed values of the audit contract.
AUDIT = "__audit"
RESULT = "__transformresult"
DETAILS = "__details"
DETAIL_NAME = "__transformationname"
DETAIL_TEXT = "__transformresult_text"
DETAIL_QUALITY = "__transformresult_quality"
QUALITY = {"PASS": 100, "WARN": 90, "FAIL": 0}

DETAIL_TYPE = T.StructType(
    [
        T.StructField(DETAIL_NAME, T.StringType()),
        T.StructField(RESULT, T.StringType()),
        T.StructField(DETAIL_TEXT, T.StringType()),
        T.StructField(DETAIL_QUALITY, T.ByteType()),
    ]
)
AUDIT_TYPE = T.StructType(
    [T.StructField(RESULT, T.StringType()), T.StructField(DETAILS, T.ArrayType(DETAIL_TYPE))]
)

DETAIL_LEVELS = ("all", "not_passed", "none")


def result_of(code: int) -> str:
    return "PASS" if code <= 0 else "WARN" if code == 1 else "FAIL"


def result_sql(code: str) -> str:
    return f"CASE WHEN {code} <= 0 THEN 'PASS' WHEN {code} = 1 THEN 'WARN' WHEN {code} > 1 THEN 'FAIL' END"


def quality_sql(code: str) -> str:
    cases = f"WHEN {code} <= 0 THEN {QUALITY['PASS']} WHEN {code} = 1 THEN {QUALITY['WARN']} WHEN {code} > 1 THEN {QUALITY['FAIL']}"
    return f"CAST(CASE {cases} END AS TINYINT)"


def no_details() -> str:
    return f"CAST(array() AS ARRAY<{ddl(DETAIL_TYPE)}>)"


def verdict_sql(codes: list[str]) -> str:
    """PASS unless a code says otherwise; NULL codes do not count."""
    worst = greatest(["0", *codes]) if codes else "0"
    return f"CASE {worst} WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END"


def old_verdict_sql() -> str:
    old = f"{quote(AUDIT)}.{quote(RESULT)}"
    unknown = f"raise_error(concat('not a rule result: ', {old}))"
    return f"CASE WHEN {old} IS NULL OR {old} = 'PASS' THEN 0 WHEN {old} = 'WARN' THEN 1 WHEN {old} = 'FAIL' THEN 2 ELSE {unknown} END"


def details_sql(record: Record, level: str, permissive: bool) -> str | None:
    """Details of one record in execution order, as SQL text of an array."""
    parts = []
    for group in record.groups:
        if isinstance(group, TestGroup):
            parts.append(_group_details(group, level, permissive))
        else:
            inner = details_sql(group.body, level, permissive)
            if inner:
                codes = group.body.codes_ref  # NULL for an element that is no record
                inner = f"CASE WHEN {codes} IS NOT NULL THEN {inner} ELSE {no_details()} END"
                rows = f"flatten(transform({group.ref}, ({codes}, {group.index}) -> {inner}))"
                parts.append(f"coalesce({rows}, {no_details()})")
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"


def _detail(test: Test, result: str, quality: str) -> str:
    return struct(
        {DETAIL_NAME: literal(test.name), RESULT: result, DETAIL_TEXT: path_sql(test.path), DETAIL_QUALITY: quality}
    )


def _group_details(group: TestGroup, level: str, permissive: bool) -> str:
    lowest = WAIVED if any(t.code_if_false == WAIVED for t in group.tests) else 0
    highest = ERROR if permissive else 2
    if all(is_static(t.path) for t in group.tests):
        tables = [_detail_table(t, lowest, highest, level) for t in group.tests]
        shift = f" - ({lowest})" if lowest else ""
        rows = array([f"get({array(tab)}, {t.read()}{shift})" for tab, t in zip(tables, group.tests)])
    else:
        rows = array([_element_detail(t, level) for t in group.tests])
    # The lambda also keeps the projection out of the fused method, which many tests would make too large for the JIT.
    rows = f"filter({rows}, d -> d IS NOT NULL)"
    if level == "not_passed":
        # most records pass, and then there is nothing to build
        rows = f"CASE WHEN array_max({group.ref}) > 0 THEN {rows} END"
    return f"coalesce({rows}, {no_details()})"


def _detail_table(test: Test, lowest: int, highest: int, level: str) -> list[str]:
    """The detail for each possible code; constant, so it is built once per query."""
    entries = []
    for code in range(lowest, highest + 1):
        result = result_of(code)
        if test.silent or (level == "not_passed" and result == "PASS"):
            entries.append(f"CAST(NULL AS {ddl(DETAIL_TYPE)})")
        else:
            entries.append(_detail(test, literal(result), f"CAST({QUALITY[result]} AS TINYINT)"))
    return entries


def _element_detail(test: Test, level: str) -> str:
    code = test.read()
    if test.silent:
        return f"CAST(NULL AS {ddl(DETAIL_TYPE)})"
    wanted = f"{code} > 0" if level == "not_passed" else f"{code} IS NOT NULL"
    return f"CASE WHEN {wanted} THEN {_detail(test, result_sql(code), quality_sql(code))} END"


def error_names_sql(record: Record) -> str:
    """Names of the tests whose condition was neither true nor false."""
    parts = []
    for group in record.groups:
        if isinstance(group, ElementGroup):
            inner = f"flatten(transform({group.ref}, {group.body.codes_ref} -> {error_names_sql(group.body)}))"
            parts.append(f"coalesce({inner}, CAST(array() AS ARRAY<STRING>))")
        else:
            names = array([f"CASE WHEN {t.read()} = {ERROR} THEN {literal(t.name)} END" for t in group.tests])
            parts.append(f"filter({names}, d -> d IS NOT NULL)")
    return "concat(" + ", ".join(parts) + ")" if parts else "CAST(array() AS ARRAY<STRING>)"
