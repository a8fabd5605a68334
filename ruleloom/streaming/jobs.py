"""Continuous validation.

Validation is a narrow projection, so a stream job is ``readStream``, the same
``validate`` as in batch, ``writeStream``.  Progress lives in the checkpoint; a
restarted job goes on after the last committed batch.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..model import RuleFile
from ..operators.routing import Route, name_schemas, validate_routed
from ..plans.engine import validate
from ..sources.kafka import sink_columns

ERRORS = "__rule_errors"
QUARANTINED = "quarantined"


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for checkpoints and results that driver and executors share.

    It lies in ``spark.checkpoint.dir``, else in ``spark.sql.streaming.checkpointLocation``, else in the
    warehouse, which Spark always has.  A warehouse on the local disk is refused where executors run on other machines.
    """
    named = (spark.conf.get(key, None) for key in ("spark.checkpoint.dir", "spark.sql.streaming.checkpointLocation"))
    base = next((b for b in named if b), None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if urlparse(base).scheme in ("", "file") and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {base} is one of each machine")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str, schema: T.StructType, *, format: str = "parquet",
               max_files_per_trigger: int | None = None) -> DataFrame:
    """A folder of files as a stream; the schema is given, never inferred."""
    reader = spark.readStream.format(format).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def write_files(df: DataFrame, path: str, checkpoint: str, *, partition_by: list[str] | None = None,
                name: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Start writing parquet, exactly once per input row; without an interval what is there now, then stop."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for a bounded query and raise what made it fail, if anything."""
    query.awaitTermination()
    error = query.exception()
    if error is not None:
        raise error
    return query


def validate_topic(
    messages: DataFrame, routes: dict[str, Route], schema_names: dict[int, str], codec, output_topic: str, *,
    keep_partition: bool = True, quarantine_topic: str | None = None, **options
) -> DataFrame:
    """Framed messages of a topic to the rows of the Kafka sink: key kept, values validated.

    ``keep_partition`` wants topics with the same number of partitions.  With ``quarantine_topic`` messages that
    could not be decoded or have a condition without a result go there, instead of stopping the job.
    """
    named = name_schemas(messages, schema_names)
    if quarantine_topic:
        options |= {"mode": "permissive", "error_column": ERRORS}
    done = validate_routed(named, routes, payload="value", codec=codec, **options)
    topic = F.when(F.size(ERRORS) > 0, quarantine_topic).otherwise(output_topic) if quarantine_topic else output_topic
    return sink_columns(done, topic, partition="partition" if keep_partition else None)


def with_quarantine(df: DataFrame, rules: RuleFile, **options) -> DataFrame:
    """Validated rows, those with a condition that had no result flagged instead of stopping the job.

    Written with ``partition_by=["quarantined"]`` both kinds part in a single
    pass; for Kafka the flag selects the topic of each row.
    """
    checked = validate(df, rules, mode="permissive", error_column=ERRORS, **options)
    return checked.withColumn(QUARANTINED, F.size(ERRORS) > 0)
