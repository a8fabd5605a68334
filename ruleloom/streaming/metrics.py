"""Throughput figures of running streams, from every progress event that Spark reports."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.reports import verdict

OBSERVED = "verdicts"


def observe_verdicts(df: DataFrame, name: str = OBSERVED) -> DataFrame:
    """Count records per verdict on the way to the sink; no extra pass, no shuffle."""
    counts = [F.count(F.lit(1)).alias("records")]
    counts += [F.count(F.when(verdict() == v, 1)).alias(v.lower()) for v in ("PASS", "WARN", "FAIL")]
    return df.observe(name, *counts)


@dataclass
class StreamStatus:
    """Totals over all batches of one query, those without rows too: an empty file of the input makes one."""

    rows: int = 0
    batches: int = 0
    busy_ms: int = 0
    passed: int = 0
    warned: int = 0
    failed: int = 0
    last_timestamp: str | None = None
    error: str | None = None

    @property
    def rows_per_second(self) -> float | None:
        return self.rows / (self.busy_ms / 1000) if self.busy_ms else None

    @property
    def ms_per_row(self) -> float | None:
        return self.busy_ms / self.rows if self.rows else None


class StreamMetrics(StreamingQueryListener):
    """Adds up the figures of all streams of a session; register it before they start.

    Spark keeps only the last progress reports of a query, but sends every one to its listeners, so no batch is missed however
    many there are.  Totals go by the query's id, which outlives restarts from the same checkpoint.
    """

    def __init__(self, spark: SparkSession):
        self._totals: dict[str, StreamStatus] = {}
        self._ended: set[str] = set()
        self._news = threading.Condition()
        self._spark = spark
        spark.streams.addListener(self)

    def close(self) -> None:
        self._spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's name
        with self._news:
            self._totals.setdefault(str(event.id), StreamStatus())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        with self._news:
            status = self._totals.setdefault(str(progress.id), StreamStatus())
            status.batches += 1
            status.rows += progress.numInputRows
            status.busy_ms += progress.durationMs.get("triggerExecution", 0)
            status.last_timestamp = progress.timestamp
            observed = (progress.observedMetrics or {}).get(OBSERVED)
            if observed is not None:
                status.passed += observed["pass"]
                status.warned += observed["warn"]
                status.failed += observed["fail"]

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._news:
            self._totals.setdefault(str(event.id), StreamStatus()).error = event.exception
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def status(self, query: StreamingQuery) -> StreamStatus:
        """The totals so far."""
        with self._news:
            return self._totals.setdefault(str(query.id), StreamStatus())

    def final(self, query: StreamingQuery, timeout: float = 60) -> StreamStatus:
        """The totals of an ended query; events arrive in order, the end last."""
        with self._news:
            if not self._news.wait_for(lambda: str(query.runId) in self._ended, timeout):
                raise TimeoutError(f"no end of query {query.runId} reported within {timeout} s")
        return self.status(query)
