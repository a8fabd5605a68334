"""The Spark type of an Avro schema given as JSON text."""

from __future__ import annotations

import json

from pyspark.sql import types as T

# Avro primitive types and the logical types that change the Spark type.
PRIMITIVES = {
    "boolean": T.BooleanType(),
    "bytes": T.BinaryType(),
    "double": T.DoubleType(),
    "enum": T.StringType(),
    "fixed": T.BinaryType(),
    "float": T.FloatType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "string": T.StringType(),
    "null": T.NullType(),
}
LOGICAL = {
    "BYTE": T.ByteType(),
    "timestamp-millis": T.TimestampType(),
    "timestamp-micros": T.TimestampType(),
    "date": T.DateType(),
}

# Fixed value: the audit field of the output contract, in Avro.
AUDIT_FIELD = {
    "name": "__audit",
    "default": None,
    "type": ["null", {
        "type": "record",
        "name": "__audit",
        "fields": [
            {"name": "__transformresult", "type": "string"},
            {"name": "__details", "default": None, "type": ["null", {"type": "array", "items": {
                "type": "record",
                "name": "__audit_details",
                "fields": [
                    {"name": "__transformationname", "type": "string"},
                    {"name": "__transformresult", "type": "string"},
                    {"name": "__transformresult_text", "type": ["null", "string"], "default": None},
                    {"name": "__transformresult_quality", "type": ["null", {"type": "int", "logicalType": "BYTE"}], "default": None},
                ],
            }}]},
        ],
    }],
}


def schema_name(avro: str | dict) -> str:
    """Full name (namespace included) of a record schema."""
    node = json.loads(avro) if isinstance(avro, str) else avro
    name, space = node["name"], node.get("namespace")
    return name if "." in name or not space else f"{space}.{name}"


def cleansed_name(name: str) -> str:
    """Name of the schema that gained the audit field."""
    return f"{name}_CLEANSED"


def struct_type(avro: str | dict) -> T.StructType:
    """The Spark type of a record schema.

    Named types are known by their full names, references resolve in the namespace around them.
    A type that contains itself has no Spark type and is refused.
    """
    node = json.loads(avro) if isinstance(avro, str) else avro
    dtype, _ = _convert(node, {}, "")
    if not isinstance(dtype, T.StructType):
        raise ValueError("the outermost Avro schema must be a record")
    return dtype


def _full_name(name: str, space: str) -> str:
    return name if "." in name or not space else f"{space}.{name}"


def _named(name: str, named: dict, space: str) -> T.DataType:
    for full in (_full_name(name, space), name):
        if full in named:
            if named[full] is None:
                raise ValueError(f"the Avro type {full!r} contains itself; Spark has no recursive types")
            return named[full]
    raise ValueError(f"unknown Avro type {name!r}")


def _convert(node, named: dict, space: str) -> tuple[T.DataType, bool]:
    """(type, nullable).  ``named`` holds the types defined so far by full name, None while one is being defined."""
    if isinstance(node, list):
        members = [m for m in node if _kind(m) != "null"]
        nullable = len(members) < len(node)
        if len(members) == 1:
            return _convert(members[0], named, space)[0], nullable
        fields = [T.StructField(f"member{n}", _convert(m, named, space)[0]) for n, m in enumerate(members)]
        return T.StructType(fields), nullable
    if isinstance(node, str):
        return (PRIMITIVES[node] if node in PRIMITIVES else _named(node, named, space)), node == "null"
    kind = node["type"]
    if kind in ("record", "enum", "fixed"):
        full = _full_name(node["name"], node.get("namespace", space))
        inner = full.rpartition(".")[0]
    if kind == "record":
        named[full], fields = None, []
        for f in node["fields"]:
            dtype, nullable = _convert(f["type"], named, inner)
            fields.append(T.StructField(f["name"], dtype, nullable))
        named[full] = T.StructType(fields)
        return named[full], False
    if kind == "array":
        dtype, nullable = _convert(node["items"], named, space)
        return T.ArrayType(dtype, nullable), False
    if kind == "map":
        dtype, nullable = _convert(node["values"], named, space)
        return T.MapType(T.StringType(), dtype, nullable), False
    if isinstance(kind, (dict, list)):
        return _convert(kind, named, space)
    logical = node.get("logicalType")
    if logical == "decimal":
        dtype = T.DecimalType(node["precision"], node.get("scale", 0))
    else:
        dtype = LOGICAL.get(logical) or PRIMITIVES.get(kind) or _named(kind, named, space)
    if kind in ("enum", "fixed"):
        named[full] = dtype
    return dtype, kind == "null"


def audited_schema(avro: str | dict) -> str:
    """The schema text of validated records: the audit field added, and the name that says so.

    A schema that has the audit field already keeps it.  Types that refer to the record by its own name still mean the
    record before; such recursion is refused when the Spark type is made.
    """
    node = json.loads(avro) if isinstance(avro, str) else json.loads(json.dumps(avro))
    node["name"] = cleansed_name(node["name"])
    if all(f["name"] != "__audit" for f in node["fields"]):
        node["fields"] = [*node["fields"], AUDIT_FIELD]
    return json.dumps(node)


def _kind(node) -> str | None:
    return node if isinstance(node, str) else node.get("type") if isinstance(node, dict) else None
