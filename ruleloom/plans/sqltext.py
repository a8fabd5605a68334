"""Small helpers for writing Spark SQL expression text."""

from __future__ import annotations

from pyspark.sql import types as T


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS STRING)"
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"{literal(n)}, {e}" for n, e in fields.items()) + ")"


def array(items: list[str]) -> str:
    return "array(" + ", ".join(items) + ")"


def all_of(predicates: list[str]) -> str:
    return " AND ".join(f"({p})" for p in predicates)


def greatest(items: list[str]) -> str:
    return items[0] if len(items) == 1 else "greatest(" + ", ".join(items) + ")"


def when(predicates: list[str], then: str) -> str:
    """``then`` where every predicate holds, NULL elsewhere, tested one by one."""
    for predicate in reversed(predicates):
        then = f"CASE WHEN {predicate} THEN {then} END"
    return then


def ddl(dtype: T.DataType) -> str:
    """The type as text for CAST, with every field name quoted."""
    if isinstance(dtype, T.StructType):
        return "STRUCT<" + ", ".join(f"{quote(f.name)}: {ddl(f.dataType)}" for f in dtype.fields) + ">"
    if isinstance(dtype, T.ArrayType):
        return f"ARRAY<{ddl(dtype.elementType)}>"
    if isinstance(dtype, T.MapType):
        return f"MAP<{ddl(dtype.keyType)}, {ddl(dtype.valueType)}>"
    return dtype.simpleString()
