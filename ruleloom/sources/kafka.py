"""Kafka topics as source and sink.  Needs the Kafka connector on the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rulefiles import TopicRule


def read_topic(
    spark: SparkSession,
    rule: TopicRule,
    bootstrap_servers: str,
    *,
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Messages of the input topic as a stream of key, value, topic, partition, offset."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("subscribe", rule.input_topic)
        .option("groupIdPrefix", rule.consumer_group)
        .option("startingOffsets", starting_offsets)
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.options(**(options or {})).load()


def sink_columns(df: DataFrame, topic: str | Column, *, key: str = "key", value: str = "value",
                 partition: str | None = None) -> DataFrame:
    """The columns the Kafka sink expects.

    With ``partition`` a message keeps its partition number, which wants input
    and output topic to have the same number of partitions.  The projection is
    narrow, so messages of one partition stay in order.
    """
    columns = [F.col(key).alias("key"), F.col(value).alias("value")]
    columns.append((F.lit(topic) if isinstance(topic, str) else topic).alias("topic"))
    if partition:
        columns.append(F.col(partition).cast("int").alias("partition"))
    return df.select(columns)


def write_topic(df: DataFrame, bootstrap_servers: str, checkpoint: str, *, interval: str = "60 seconds",
                options: dict[str, str] | None = None):
    """Start writing ``sink_columns`` to Kafka; progress is kept in ``checkpoint`` (at least once)."""
    return (
        df.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("checkpointLocation", checkpoint)
        .options(**(options or {}))
        .trigger(processingTime=interval)
        .start()
    )


def read_recent(
    spark: SparkSession, topics: list[str], bootstrap_servers: str, ends: dict[str, dict[int, int]], last: int = 10,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """The last messages before the end offsets of each partition, as a batch."""
    import json

    until = json.dumps({t: {str(p): end for p, end in parts.items()} for t, parts in ends.items()})
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers).option("subscribe", ",".join(topics))
    reader = reader.option("startingOffsets", recent_offsets(ends, last)).option("endingOffsets", until)
    return reader.options(**(options or {})).load()


def recent_offsets(ends: dict[str, dict[int, int]], last: int = 10) -> str:
    """``startingOffsets`` for the last messages of each partition, from the end offsets."""
    import json

    return json.dumps({t: {str(p): max(0, end - last) for p, end in parts.items()} for t, parts in ends.items()})
