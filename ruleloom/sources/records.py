"""Records as JSON text, as framed bytes and in another version of their schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sqltext import ddl, literal, quote, struct

MAGIC = b"\x00"


def to_json(df: DataFrame, name: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Every record as one JSON object, NULL fields included, next to the columns in ``keep``."""
    payload = F.to_json(F.struct(*[F.col(quote(c)) for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(*[F.col(quote(c)) for c in keep or []], payload.alias(name))


def from_json(df: DataFrame, column: str, schema: T.StructType, mode: str = "FAILFAST") -> DataFrame:
    """The fields of JSON records as columns; broken text stops the job unless ``PERMISSIVE``."""
    others = [F.col(quote(c)) for c in df.columns if c != column]
    parsed = F.from_json(F.col(quote(column)), schema, {"mode": mode}).alias("__record")
    parsed_frame = df.select(*others, parsed)
    fields = [F.col("__record").getField(f.name).alias(f.name) for f in schema.fields]
    return parsed_frame.select(*others, *fields)


def split_frame(df: DataFrame, value: str = "value") -> DataFrame:
    """Framed values (0 byte, 4-byte schema id, body) as ``schema_id`` and ``body``.

    A value without the leading 0 byte stops the job; a NULL value stays NULL.
    """
    v = quote(value)
    message = literal("a framed value starts with a zero byte and four bytes of schema id")
    valid = f"CASE WHEN {v} IS NULL THEN true WHEN length({v}) >= 5 AND substring({v}, 1, 1) = X'00' THEN true ELSE raise_error({message}) END"
    schema_id = f"CASE WHEN {valid} THEN CAST(conv(hex(substring({v}, 2, 4)), 16, 10) AS INT) END"
    return df.select("*", F.expr(schema_id).alias("schema_id"), F.expr(f"substring({v}, 6)").alias("body"))


def framed_id(value: Column) -> Column:
    """The schema id in a framed value."""
    return F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("int")


def frame(schema_id: Column, body: Column) -> Column:
    """The framed value for a body, the reverse of ``split_frame``."""
    hex_id = F.lpad(F.hex(schema_id), 8, "0")
    return F.concat(F.lit(bytearray(MAGIC)), F.unhex(hex_id), body)


def avro_functions():
    """Spark's Avro functions; they need the Avro package on the cluster."""
    try:
        from pyspark.sql.avro import functions as avro
    except ImportError as missing:  # pragma: no cover - depends on the deployment
        raise RuntimeError("framed Avro needs the spark-avro package") from missing
    return avro


def read_framed_avro(df: DataFrame, reader_schema: str, value: str = "value") -> DataFrame:
    """Framed Avro values as columns of the reader schema."""
    avro = avro_functions()
    parts = split_frame(df, value)
    return parts.select("*", avro.from_avro(F.col("body"), reader_schema).alias("record")).select(
        *[F.col(quote(c)) for c in df.columns if c != value], "record.*"
    )


def write_framed_avro(df: DataFrame, schema_id: int, avro_schema: str, columns: list[str]) -> Column:
    """The framed Avro value of ``columns``."""
    avro = avro_functions()
    return frame(F.lit(schema_id), avro.to_avro(F.struct(*[F.col(quote(c)) for c in columns]), avro_schema))


def align(df: DataFrame, target: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns in the order and types of ``target``, at every depth.

    A field the data lacks gets its default (top level) or NULL; a field the
    target lacks is left out.
    """
    defaults = defaults or {}
    have = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for f in target.fields:
        if f.name in have:
            columns.append(F.expr(_align(quote(f.name), have[f.name], f.dataType, 0)).alias(f.name))
        else:
            columns.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(columns)


def align_column(record: Column, have: T.StructType, target: T.StructType, defaults: dict[str, object] | None = None, keep=()) -> Column:
    """A record brought to the fields and types of ``target``; those in ``keep`` go along behind.  NULL stays NULL."""
    defaults, known = defaults or {}, {f.name: f.dataType for f in have.fields}

    def build(r: Column) -> Column:
        parts = []
        for f in target.fields:
            own = r.getField(f.name).cast(f.dataType) if f.name in known else F.lit(defaults.get(f.name)).cast(f.dataType)
            parts.append(own.alias(f.name))
        return F.struct(*parts, *[r.getField(k).alias(k) for k in keep])

    # bound by a lambda, so that the record is decoded once
    return F.get(F.transform(F.array(record), lambda r: F.when(r.isNotNull(), build(r))), F.lit(0))


def _align(ref: str, have: T.DataType, want: T.DataType, depth: int) -> str:
    if have == want:
        return ref
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        known = {f.name: f.dataType for f in have.fields}
        fields = {
            f.name: _align(f"{ref}.{quote(f.name)}", known[f.name], f.dataType, depth)
            if f.name in known
            else f"CAST(NULL AS {ddl(f.dataType)})"
            for f in want.fields
        }
        return f"CASE WHEN {ref} IS NOT NULL THEN {struct(fields)} END"
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        name = f"a{depth}"
        return f"transform({ref}, {name} -> {_align(name, have.elementType, want.elementType, depth + 1)})"
    return f"CAST({ref} AS {ddl(want)})"
