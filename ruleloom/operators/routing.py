"""One stream of records of many schemas, each with its own rule file.

The input is read once and nothing is shuffled.  One route after the other takes
its own records: it parses their payload, runs its rules on the parsed fields and
puts the new payload in place; only the payload goes on to the next route.  No two
routes share columns, so a record pays for its own rules and for one comparison per
other route, and names or types that clash between schemas do not matter.  Records
whose schema has no rules, and NULL records, keep their payload as it is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import RuleFile
from ..plans.audit import AUDIT, AUDIT_TYPE
from ..plans.engine import validate
from ..plans.sqltext import literal, quote
from ..sources.avro_schema import audited_schema, schema_name
from ..sources.records import align_column, avro_functions, frame, framed_id, split_frame

UNDECODABLE = "the payload could not be decoded"
UNKNOWN_FIELDS = ("carry", "refuse", "drop")
_CORRUPT = "__corrupt_payload"


@dataclass(frozen=True)
class Route:
    """Rules for records of one schema.  ``avro`` is the schema's Avro text where records are framed Avro."""

    rules: RuleFile
    schema: T.StructType
    avro: str | None = None


class JsonRecords:
    """Payload columns of JSON text."""

    def decode(self, payload: Column, name: str, route: Route, permissive: bool) -> Column:
        """The record; in permissive mode with a further field that holds what could not be decoded."""
        if not permissive:
            return F.from_json(payload, route.schema, {"mode": "FAILFAST"})
        schema = T.StructType([*route.schema.fields, T.StructField(_CORRUPT, T.StringType())])
        return F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})

    def encode(self, record: Column, payload: Column, name: str, route: Route) -> Column:
        return F.to_json(record, {"ignoreNullFields": "false"})

    def text(self, payload: Column) -> Column:
        return payload


@dataclass(frozen=True)
class FramedJson:
    """Framed values whose body is JSON, in several versions of a schema.

    ``layouts`` has the schema name and the writer's type for each schema id.  Every record is read in the layout it was written
    in and brought to the type of its route: fields it lacks get ``defaults`` of the schema, else NULL.  ``output_ids``
    are the ids of the validated schemas.
    """

    layouts: dict[int, tuple[str, T.StructType]]
    output_ids: dict[str, int]
    defaults: dict[str, dict[str, object]] = field(default_factory=dict)

    def decode(self, payload: Column, name: str, route: Route, permissive: bool) -> Column:
        body, found = self.text(payload), F.lit(None).cast(_with_corrupt(route.schema) if permissive else route.schema)
        for number, (own, layout) in self.layouts.items():
            if own == name:
                record = JsonRecords().decode(body, name, Route(route.rules, layout), permissive)
                record = align_column(record, layout, route.schema, self.defaults.get(name), [_CORRUPT] if permissive else [])
                found = F.when(framed_id(payload) == number, record).otherwise(found)
        return found

    def encode(self, record: Column, payload: Column, name: str, route: Route) -> Column:
        body = F.to_json(record, {"ignoreNullFields": "false"}).cast("binary")
        return frame(F.lit(self.output_ids[name]), body)

    def text(self, payload: Column) -> Column:
        return F.substring(payload, 6, 2**31 - 1).cast("string")


@dataclass(frozen=True)
class FramedAvro:
    """Framed Avro; needs the Avro package on the cluster.

    ``writers`` has the Avro schema text for each schema id: a record is decoded with the schema it was written with, and the
    route's schema resolves it, so fields added later get their defaults.  The schema of validated records follows from the
    route's; ``output_ids`` are the ids it is registered under.
    """

    writers: dict[int, str]
    output_ids: dict[str, int]

    def decode(self, payload: Column, name: str, route: Route, permissive: bool) -> Column:
        body, mode = F.substring(payload, 6, 2**31 - 1), "PERMISSIVE" if permissive else "FAILFAST"
        options, found = {"mode": mode, "avroSchema": route.avro}, F.lit(None)
        for number, writer in self.writers.items():
            if schema_name(writer) == name:
                record = avro_functions().from_avro(body, writer, options)
                found = F.when(framed_id(payload) == number, record).otherwise(found)
        return found

    def encode(self, record: Column, payload: Column, name: str, route: Route) -> Column:
        return frame(F.lit(self.output_ids[name]), avro_functions().to_avro(record, audited_schema(route.avro)))

    def text(self, payload: Column) -> None:
        """Avro records have no fields that their schema lacks."""
        return None


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])


def name_schemas(messages: DataFrame, names: dict[int, str], *, value: str = "value", column: str = "schema_name") -> DataFrame:
    """Framed messages with the schema name their id stands for; NULL for ids without rules.  The frame stays in the value."""
    ids = split_frame(messages, value).drop("body")
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else None
    named = known[F.col("schema_id")] if names else F.lit(None).cast("string")
    named = F.when(F.col("schema_id").isin(list(names)), named) if names else named
    return ids.withColumn(column, named).drop("schema_id")


def validate_routed(
    df: DataFrame,
    routes: dict[str, Route],
    *,
    schema_column: str = "schema_name",
    payload: str = "payload",
    codec=None,
    flag: str | None = None,
    unknown: str = "carry",
    error_column: str | None = None,
    **options,
) -> DataFrame:
    """Validate records by the rules of their schema; same columns out as in.

    The payload is JSON text unless ``codec`` says otherwise.  ``flag`` names a
    further column telling whether rules applied to the record.

    A payload that cannot be decoded, or has a field of another type, stops the job in strict mode.  In permissive mode it
    stays as it is, no rules apply, and ``error_column`` says so; for all other records that column names the tests without a result.
    ``unknown`` says what happens to fields of the outermost record that the route's schema lacks: ``carry`` them over
    behind the known ones, ``refuse`` the record (as one that cannot be decoded), or ``drop`` them.  Unknown fields of
    nested records are not kept.

    Further ``options`` are those of ``validate``.
    """
    if unknown not in UNKNOWN_FIELDS:
        raise ValueError(f"unknown must be one of {UNKNOWN_FIELDS}, not {unknown!r}")
    permissive = options.get("mode") == "permissive"
    if error_column and not permissive:
        raise ValueError("error_column needs mode='permissive'")
    for name in (flag, error_column):
        if name in df.columns:
            raise ValueError(f"there is a column {name!r} already")

    def outside(name: str) -> str:
        return f"__rt_in_{name}"

    records = df.select(
        *[F.col(quote(c)).alias(outside(c)) for c in df.columns],
        F.lit(False).alias("__rt_applied"),
        F.lit(None).cast("array<string>").alias("__rt_errors"),
    )
    for name, route in routes.items():
        if route.rules.steps:
            records = _one_route(records, name, route, outside(schema_column), outside(payload), codec or JsonRecords(), unknown, permissive, options)
    added = [F.col("__rt_applied").alias(flag)] if flag else []
    if error_column:
        added.append(F.coalesce("__rt_errors", F.expr("CAST(array() AS ARRAY<STRING>)")).alias(error_column))
    return records.select(*[F.col(quote(outside(c))).alias(c) for c in df.columns], *added)


def _one_route(records, name, route, schema_column, payload, codec, unknown, permissive, options) -> DataFrame:
    outer = records.columns
    carried = [quote(c) for c in outer]
    own = f"{quote(schema_column)} <=> {literal(name)} AND {quote(payload)} IS NOT NULL"
    parsed = codec.decode(F.col(quote(payload)), name, route, permissive)
    sound, extra = F.col("__rt_record").isNotNull(), None
    if permissive and not isinstance(codec, FramedAvro):
        sound = sound & F.col(f"__rt_record.{_CORRUPT}").isNull()
    text = codec.text(F.col(quote(payload)))
    helpers = [F.when(F.expr(own), parsed).alias("__rt_record")]
    if text is not None and unknown != "drop":
        known = F.array(*[F.lit(f.name) for f in route.schema.fields])
        extra = F.array_except(F.json_object_keys(text), known)
        helpers.append(F.when(F.expr(own), extra).alias("__rt_extra"))
        if unknown == "refuse" and permissive:
            sound = sound & (F.coalesce(F.size("__rt_extra"), F.lit(0)) <= 0)
    records = records.select(*carried, *helpers)
    if extra is not None and unknown == "refuse" and not permissive:
        told = F.concat(F.lit(f"fields that schema {name} lacks: "), F.array_join("__rt_extra", ", "))
        refused = F.when(F.size("__rt_extra") > 0, F.raise_error(told).cast("boolean")).otherwise(True)
        sound = sound & refused
    fields = [F.col("__rt_record").getField(f.name) for f in route.schema.fields]
    fields = [
        (c.cast(AUDIT_TYPE) if f.name == AUDIT else c).alias(f.name) for c, f in zip(fields, route.schema.fields, strict=True)
    ]
    kept = ["__rt_extra"] if extra is not None else []
    records = records.select(*carried, *kept, F.expr(own).alias("__rt_own"), (F.expr(own) & sound).alias("__rt_go"), *fields)
    more = {"error_column": "__rt_names"} if permissive else {}
    done = validate(records, route.rules, only_rows="__rt_go", **options, **more)

    columns = [f.name for f in route.schema.fields if f.name != AUDIT] + [AUDIT]
    encoded = codec.encode(F.struct(*[F.col(quote(c)) for c in columns]), F.col(quote(payload)), name, route)
    if extra is not None and unknown == "carry":
        encoded = F.when(F.size("__rt_extra") > 0, _carry(codec, encoded, text, name)).otherwise(encoded)
    broken = F.col("__rt_own") & ~F.col("__rt_go")
    errors = F.col("__rt_errors")
    if permissive:
        errors = F.when(F.col("__rt_go"), F.col("__rt_names")).when(broken, F.array(F.lit(UNDECODABLE))).otherwise(errors)
    changed = {
        payload: F.when(F.col("__rt_go"), encoded).otherwise(F.col(quote(payload))),
        "__rt_applied": F.col("__rt_applied") | F.coalesce("__rt_go", F.lit(False)),
        "__rt_errors": errors,
    }
    return done.select(*[changed[c].alias(c) if c in changed else F.col(quote(c)) for c in outer])


def _carry(codec, encoded: Column, text: Column, name: str) -> Column:
    """The encoded record with the unknown fields of its JSON text, as they were, at the end."""
    wanted = F.map_filter(F.parse_json(text).cast("map<string,variant>"), lambda key, _: F.array_contains("__rt_extra", key))
    tail = F.substring(F.to_json(wanted), 2, 2**31 - 1)

    def joined(body: Column) -> Column:
        return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(","), tail)

    if isinstance(codec, FramedJson):
        return frame(F.lit(codec.output_ids[name]), joined(codec.text(encoded)).cast("binary"))
    return joined(encoded)
