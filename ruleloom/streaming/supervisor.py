"""Several validation jobs in one session, each with its own query, checkpoint and end."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.rulefiles import TopicRule
from .failures import Failure, record_failure
from .metrics import StreamMetrics, StreamStatus
from .replay import write_batches


class State(str, Enum):
    NEW, RUNNING, STOPPED, FINISHED, FAILED = "new", "running", "stopped", "finished", "failed"


@dataclass(frozen=True)
class StreamJob:
    """What a job reads and validates, and how it is started.

    ``start`` gets the session and returns the running query, which must go on from ``checkpoint``.  ``rules`` is a topic job's
    setting, if it has one.
    """

    name: str
    checkpoint: str
    start: Callable[[SparkSession], StreamingQuery]
    rules: TopicRule | None = None


def file_job(name: str, source: Callable[[SparkSession], DataFrame], path: str, checkpoint: str, *, interval: str | None = None, **options) -> StreamJob:
    """A job that writes what ``source`` gives to batch folders below ``path``."""
    return StreamJob(name, checkpoint, lambda spark: write_batches(source(spark), path, checkpoint, name=name, interval=interval, **options))


@dataclass(frozen=True)
class JobStatus:
    name: str
    state: State
    runs: int
    rows: int
    batches: int
    failure: Failure | None


class _Held:
    def __init__(self, job: StreamJob):
        self.job, self.query, self.runs = job, None, 0
        self.stopped, self.failure, self.recorded = False, None, None


class Supervisor:
    """Starts, stops and restarts jobs by name and tells how they fare.

    Jobs share the session's executors but nothing else: one that fails leaves the others running, its error is stored next to its
    checkpoint, and it goes on from there when it is started again.  Each job's batches are scheduled in a pool of its name.  Use it
    as a context: its end stops what is still running.
    """

    def __init__(self, spark: SparkSession, jobs: list[StreamJob] = ()):
        self._spark, self._lock, self._held = spark, threading.RLock(), {}
        self._metrics = StreamMetrics(spark)
        for job in jobs:
            self.add(job)

    def __enter__(self) -> Supervisor:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def add(self, job: StreamJob) -> None:
        """Take a job in without starting it; two jobs may share neither name nor checkpoint nor input topic."""
        with self._lock:
            for other in (h.job for h in self._held.values()):
                if other.name == job.name or other.checkpoint == job.checkpoint:
                    raise ValueError(f"jobs {other.name!r} and {job.name!r} share name or checkpoint")
                if job.rules and other.rules and job.rules.input_topic == other.rules.input_topic:
                    raise ValueError(f"jobs {other.name!r} and {job.name!r} read the same topic")
            self._held[job.name] = _Held(job)

    def replace(self, job: StreamJob) -> None:
        """Stop the job of this name and take its new version; started, it goes on from the same checkpoint."""
        with self._lock:
            runs = self._of(job.name).runs
            self.stop(job.name)
            del self._held[job.name]
            self.add(job)
            self._held[job.name].runs = runs

    def _of(self, name: str) -> _Held:
        if name not in self._held:
            raise KeyError(f"no job {name!r}; there are {sorted(self._held)}")
        return self._held[name]

    def start(self, name: str | None = None) -> None:
        """Start a job, or all that are not running; a job that cannot be started does not keep the others from it."""
        errors = []
        with self._lock:
            for held in [self._of(name)] if name else list(self._held.values()):
                if held.query is not None and held.query.isActive:
                    continue
                context = self._spark.sparkContext
                before = context.getLocalProperty("spark.scheduler.pool")
                try:
                    context.setLocalProperty("spark.scheduler.pool", held.job.name)
                    held.query, held.stopped, held.failure = held.job.start(self._spark), False, None
                    held.runs += 1
                except Exception as error:
                    errors.append(error)
                finally:
                    context.setLocalProperty("spark.scheduler.pool", before)
        if errors:
            raise ExceptionGroup("jobs that could not be started", errors)

    def stop(self, name: str | None = None) -> None:
        """Stop a job, or all; the batch it is in is done again at the next start."""
        with self._lock:
            for held in [self._of(name)] if name else list(self._held.values()):
                if held.query is not None and held.query.isActive:
                    held.query.stop()
                    held.stopped = True

    def restart(self, name: str) -> None:
        with self._lock:
            self.stop(name)
            self.start(name)

    def restart_failed(self) -> list[str]:
        """Start again what has failed; returns their names."""
        with self._lock:
            names = [s.name for s in self.status() if s.state is State.FAILED]
            for name in names:
                self.start(name)
            return names

    def wait(self, timeout: float | None = None) -> None:
        """Until no job runs; errors stay with their jobs."""
        for held in list(self._held.values()):
            if held.query is not None:
                try:
                    held.query.awaitTermination(timeout)
                except Exception:
                    if held.query.exception() is None:
                        raise
                self._metrics.final(held.query) if not held.query.isActive else None

    def _state(self, held: _Held) -> State:
        query = held.query
        if query is None:
            return State.NEW
        if query.isActive:
            return State.RUNNING
        if query.exception() is not None:
            if held.recorded != str(query.runId):
                held.failure, held.recorded = record_failure(query, held.job.checkpoint), str(query.runId)
            return State.FAILED
        return State.STOPPED if held.stopped else State.FINISHED

    def status(self) -> list[JobStatus]:
        """One row for each job; rows and batches over all runs from its checkpoint in this session."""
        with self._lock:
            found = []
            for name, held in sorted(self._held.items()):
                state = self._state(held)
                total = self._metrics.status(held.query) if held.query is not None else StreamStatus()
                found.append(JobStatus(name, state, held.runs, total.rows, total.batches, held.failure))
            return found

    def close(self) -> None:
        self.stop()
        self._metrics.close()
