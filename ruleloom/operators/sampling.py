"""Recent records, for writing and trying out rules."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..plans.sqltext import quote


def sample_recent(
    df: DataFrame,
    partition_by: list[str],
    offset: str,
    *,
    last: int = 10,
    max_rows: int = 100,
) -> DataFrame:
    """The last records of every partition, at most ``max_rows`` in all.

    Where the limit cuts, every partition gives its newest record before any gives its second.

    Spark trims each partition group before the shuffle (window group limit),
    so even one huge partition sends only ``last`` rows per task.
    """
    newest_first = Window.partitionBy(*partition_by).orderBy(F.col(quote(offset)).desc())
    return (
        df.withColumn("__recent", F.row_number().over(newest_first))
        .where(F.col("__recent") <= last)
        .orderBy("__recent", *partition_by)
        .limit(max_rows)
        .drop("__recent")
    )


@dataclass(frozen=True)
class TimedSample:
    """A sample that had to be done in time: its rows, and the partitions that were not read to their end."""

    rows: DataFrame
    missing: list


def sample_within(
    df: DataFrame, partition: str, partitions: list, offset: str, *, seconds: float = 20.0, last: int = 10, max_rows: int = 100, jobs: int = 8
) -> TimedSample:
    """The last records of each of the ``partitions``, of those that answer within the time.

    Every partition is read by a job of its own, ``jobs`` at a time, all under one tag.  When the time is up, jobs under that tag are
    cancelled, other jobs of the session go on.  At most ``last`` rows of a partition reach the driver.  Where ``max_rows`` cuts,
    every partition gives its newest record before any gives its second.
    """
    spark, tag = df.sparkSession, f"sample-{uuid.uuid4().hex}"
    context, end, late = spark.sparkContext, time.monotonic() + seconds, False

    def newest(value) -> list[Row]:
        if late:
            raise TimeoutError
        context.addJobTag(tag)
        try:
            own = df.where(F.col(quote(partition)).eqNullSafe(F.lit(value)))
            return own.orderBy(F.col(quote(offset)).desc()).limit(last).collect()
        finally:
            context.removeJobTag(tag)

    pool = ThreadPoolExecutor(max_workers=jobs)
    asked = {value: pool.submit(inheritable_thread_target(spark)(newest), value) for value in dict.fromkeys(partitions)}
    try:
        done, rest = wait(asked.values(), timeout=max(0.0, end - time.monotonic()))
        late = True
        while rest:  # a job may have been about to start when others were cancelled
            context.cancelJobsWithTag(tag)
            _, rest = wait(rest, timeout=0.2)
    finally:
        pool.shutdown(wait=True, cancel_futures=True)
    found, missing = [], []
    for value, job in asked.items():
        if job in done:
            found += [(n, k, row) for n, row in enumerate(job.result()) for k in [len(found)]]
        else:
            missing.append(value)
    rows = [row for _, _, row in sorted(found, key=lambda f: f[:2])][:max_rows]
    return TimedSample(spark.createDataFrame(rows, df.schema), missing)


def sample_payload(sample: DataFrame, topic: str, partition: str, offset: str, record: list[str] | None = None) -> DataFrame:
    """Offset, topic, partition and the record as JSON text; made after sampling, so only for few rows."""
    columns = record or sample.columns
    keys = sample.select(
        F.col(quote(offset)).cast("long").alias("sample_offset"),
        F.col(quote(topic)).cast("string").alias("sample_topic"),
        F.col(quote(partition)).cast("int").alias("sample_partition"),
        # fixed value: how sample files are named
        F.concat(
            F.lit("partition_"), F.col(quote(partition)).cast("string"),
            F.lit("_offset_"), F.col(quote(offset)).cast("string"), F.lit(".json"),
        ).alias("filename"),
        *[F.col(quote(c)) for c in columns],
    )
    payload = F.to_json(F.struct(*[F.col(quote(c)) for c in columns]), {"ignoreNullFields": "false"})
    return keys.select("sample_offset", "sample_topic", "sample_partition", "filename", payload.alias("payload"))
