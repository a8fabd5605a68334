"""Micro-batches that can be written again: each has a folder of its own, which a replay overwrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch"


def write_batches(
    df: DataFrame, path: str, checkpoint: str, *, name: str | None = None, interval: str | None = None,
    partition_by: list[str] | None = None, after: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Start writing parquet below ``path``, the rows of batch n in the folder ``batch=n``.

    Spark repeats a batch that was not committed to the checkpoint, with the same number and the same input.  Whatever it
    had written is then overwritten, so nothing is lost and nothing is there twice, also where ``after`` (which gets the batch
    and its number once the batch is written) or the machine fails in between.  Without an interval what is there now is read, then
    the query stops.
    """

    def write(batch: DataFrame, number: int) -> None:
        writer = batch.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{path}/{BATCH}={number}")
        if after is not None:
            after(batch, number)

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that were written, with the number of their batch."""
    own = [f for f in schema.fields if f.name != BATCH]
    return spark.read.schema(T.StructType([*own, T.StructField(BATCH, T.LongType())])).parquet(path)


def order_in_files(written: DataFrame, partition: str, offset: str) -> DataFrame:
    """Whether each file holds the messages of every source partition in their order: ``file, partition, messages, first, last, breaks``.

    A break is a message whose offset is not larger than that of the message of its partition before it in the file.  ``written`` is
    read from files.  Rows are compared where they are, in the order of the file; what is shuffled is one row for each file, partition
    and task, so a partition with most of the messages is spread over tasks like any other.
    """
    rows = written.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"),
        F.col(partition).cast("string").alias("partition"), F.col(offset).cast("long").alias("offset"),
    )
    kind = "file string, partition string, at long, messages long, first long, last long, breaks long"
    runs = rows.mapInPandas(_runs, kind)
    ordered = F.sort_array(F.collect_list(F.struct("at", "first", "last", "messages", "breaks")))
    found = runs.groupBy("file", "partition").agg(ordered.alias("runs"))
    crossed = F.expr("size(filter(runs, (r, n) -> n > 0 AND r.first <= get(runs, n - 1).last))")
    total = F.expr("aggregate(runs, 0L, (sum, r) -> sum + r.messages)")
    within = F.expr("aggregate(runs, 0L, (sum, r) -> sum + r.breaks)")
    return found.select(
        "file", "partition", total.alias("messages"), F.col("runs")[0]["first"].alias("first"), F.expr("element_at(runs, -1).last").alias("last"),
        (within + crossed).alias("breaks"))


def _runs(frames):
    """One row for each file and partition of a task: its first and last offset and the breaks between them."""
    import pandas as pd

    held = {}
    for frame in frames:
        for (file, partition), own in frame.groupby(["file", "partition"], sort=False, dropna=False):
            offsets = own["offset"].to_numpy()
            key = file, None if pd.isna(partition) else partition
            before = held.get(key)
            breaks = int((offsets[1:] <= offsets[:-1]).sum())
            if before is None:
                held[key] = [int(own["at"].iloc[0]), len(own), int(offsets[0]), int(offsets[-1]), breaks]
            else:
                before[4] += breaks + int(offsets[0] <= before[3])
                before[1] += len(own)
                before[3] = int(offsets[-1])
    rows = [(file, partition, *values) for (file, partition), values in held.items()]
    yield pd.DataFrame(rows, columns=["file", "partition", "at", "messages", "first", "last", "breaks"])
