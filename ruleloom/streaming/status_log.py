"""A table of status rows: one for each batch and job, and one for each end of a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from .failures import _CONDITION, put_text

RUNNING, ENDED, FAILED = "running", "ended", "failed"
SCHEMA = (
    "query_id string, run_id string, name string, batch long, at string, state string, rows long, busy_ms long, error string"
)


class StatusLog(StreamingQueryListener):
    """Keeps the figures of every batch, also without rows, of all streams of a session; register it before they start.

    Rows are small files named by query and batch, on the shared file system: a batch that is run again replaces its row, and a
    later session, or another job with the same checkpoint, goes on in the same table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        self._names: dict[str, str | None] = {}
        self.errors: list[Exception] = []
        spark.streams.addListener(self)

    def close(self) -> None:
        self._spark.streams.removeListener(self)

    def _put(self, key: str, **row) -> None:
        try:
            put_text(self._spark, f"{self._path}/{row['query_id']}-{key}.json", json.dumps(row))
        except Exception as error:  # a full disk must not stop the streams; status_rows has fewer rows then
            self.errors.append(error)

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's name
        self._names[str(event.runId)] = event.name

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._put(
            f"batch-{p.batchId}", query_id=str(p.id), run_id=str(p.runId), name=p.name, batch=p.batchId, at=p.timestamp, state=RUNNING,
            rows=p.numInputRows, busy_ms=p.durationMs.get("triggerExecution", 0), error=None)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        run = str(event.runId)
        found = _CONDITION.findall(event.exception or "")
        self._put(
            f"end-{run}", query_id=str(event.id), run_id=run, name=self._names.pop(run, None), batch=None, at=None,
            state=FAILED if event.exception else ENDED, rows=None, busy_ms=None, error=found[-1] if found else None)


def status_rows(spark: SparkSession, path: str) -> DataFrame:
    """Batches and ends with ``rows_per_second`` and ``ms_per_row``; NULL where nothing was measured."""
    rows = spark.read.schema(SCHEMA).json(path)
    busy, count = F.nullif(F.col("busy_ms"), F.lit(0)), F.nullif(F.col("rows"), F.lit(0))
    return rows.withColumns({
        "at": F.to_timestamp("at"), "rows_per_second": F.col("rows") * 1000 / busy, "ms_per_row": F.col("busy_ms") / count})


def job_status(rows: DataFrame) -> DataFrame:
    """One row for each query, over all its runs: rows, batches, rates, time of the last batch."""
    return rows.groupBy("query_id").agg(
        F.max("name").alias("name"), F.sum("rows").alias("rows"), F.count("batch").alias("batches"),
        F.count_if(F.col("state") == FAILED).alias("failures"), F.max("at").alias("last_batch_at"),
        (F.sum("rows") * 1000 / F.nullif(F.sum("busy_ms"), F.lit(0))).alias("rows_per_second"))
