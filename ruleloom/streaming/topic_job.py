"""From the settings of a topic job to a running stream: routes, source, validation, sink."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.routing import FramedAvro, Route
from ..operators.sampling import sample_recent
from ..sources.avro_schema import schema_name, struct_type
from ..sources.kafka import read_recent, read_topic, write_topic
from ..sources.rulefiles import TopicRule
from .jobs import validate_topic


def topic_routes(rule: TopicRule, root: str | Path) -> dict[str, Route]:
    """Routes of the active rule files by the full name of their schemas; files without a schema are refused."""
    routes = {}
    for rules in rule.load(root):
        if not rules.schema:
            raise ValueError(f"rule file {rules.name!r} has no schema")
        name = schema_name(rules.schema)
        if name in routes:
            raise ValueError(f"two rule files for schema {name!r}")
        routes[name] = Route(rules, struct_type(rules.schema), rules.schema)
    return routes


def avro_codec(writers: dict[int, str], output_ids: dict[str, int]) -> FramedAvro:
    """The codec of framed Avro messages from the registered schemas by id."""
    return FramedAvro(writers, output_ids)


def plan_topic(
    messages: DataFrame, rule: TopicRule, routes: dict[str, Route], names: dict[int, str], codec, *,
    input_partitions: int | None = None, output_partitions: int | None = None, **options,
) -> DataFrame:
    """Messages of the input topic as rows of the sink.

    A message keeps its partition if both topics are known to have the same number of them; else Kafka deals by key.
    """
    same = input_partitions is not None and input_partitions == output_partitions
    return validate_topic(messages, routes, names, codec, rule.output_topic, keep_partition=same, **options)


def start_topic(
    spark: SparkSession, rule: TopicRule, root: str | Path, names: dict[int, str], codec, bootstrap_servers: str, checkpoint: str, *,
    input_partitions: int | None = None, output_partitions: int | None = None, max_offsets_per_trigger: int | None = None, **options,
) -> StreamingQuery:
    """Start the job of a topic rule; it goes on from ``checkpoint``."""
    messages = read_topic(spark, rule, bootstrap_servers, max_offsets_per_trigger=max_offsets_per_trigger)
    rows = plan_topic(
        messages, rule, topic_routes(rule, root), names, codec, input_partitions=input_partitions, output_partitions=output_partitions, **options
    )
    return write_topic(rows, bootstrap_servers, checkpoint)


def sample_topic(
    spark: SparkSession, topics: list[str], bootstrap_servers: str, ends: dict[str, dict[int, int]], *, last: int = 10, max_rows: int = 100
) -> DataFrame:
    """The last messages of every partition, read as a batch from the offsets before the ends."""
    return recent_messages(read_recent(spark, topics, bootstrap_servers, ends, last), last=last, max_rows=max_rows)


def recent_messages(messages: DataFrame, *, last: int = 10, max_rows: int = 100) -> DataFrame:
    """Of messages with topic, partition and offset the last of every partition."""
    return sample_recent(messages, ["topic", "partition"], "offset", last=last, max_rows=max_rows)


def with_schema(sample: DataFrame, schemas: dict[int, tuple[str, str]], value: str = "value") -> DataFrame:
    """Framed sample messages with ``subject`` and ``schema`` of their ids (NULL for unknown ids)."""
    from ..sources.records import framed_id

    pairs = [F.lit(x) for number, (subject, schema) in schemas.items() for x in (number, F.struct(F.lit(subject).alias("subject"), F.lit(schema).alias("schema")))]
    if not pairs:
        return sample.withColumns({"subject": F.lit(None).cast("string"), "schema": F.lit(None).cast("string")})
    number = framed_id(F.col(value))
    found = F.when(number.isin(list(schemas)), F.create_map(*pairs)[number])
    return sample.withColumns({"subject": found["subject"], "schema": found["schema"]})
