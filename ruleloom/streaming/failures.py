"""Why a stream stopped: the error's class, the rule and the batch, kept next to the checkpoint."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

# How this library and Spark word their messages.
_RULE = re.compile(r"Rule '(.*?)': ")
_CONDITION = re.compile(r"\[([A-Z][A-Z0-9_]*(?:\.[A-Z0-9_]+)*)\]")
FOLDER = "failures"


@dataclass(frozen=True)
class Failure:
    """The first error of a run.  ``batch`` is the number of the batch that failed and will be tried again."""

    query_id: str
    run_id: str
    name: str | None
    batch: int
    condition: str | None
    rule: str | None
    message: str


def failure_of(query: StreamingQuery) -> Failure | None:
    """What made an ended query fail; None if nothing did.

    The condition is that of the innermost error that names one, so a rule's error is not hidden behind that of the stream.
    """
    error = query.exception()
    if error is None:
        return None
    text = str(error)
    rule = _RULE.search(text)
    conditions = [c for c in _CONDITION.findall(text) if c != "STREAM_FAILED"]
    named = conditions[-1] if conditions else error.getCondition() if isinstance(error, PySparkException) else None
    return Failure(str(query.id), str(query.runId), query.name, _planned(query), named, rule[1] if rule else None, text.split("\n", 1)[0])


def _planned(query: StreamingQuery) -> int:
    """The number of the newest batch whose input was fixed; in a run that failed, the one it failed in."""
    java = query._jsq
    if java.getClass().getSimpleName() == "StreamingQueryWrapper":
        java = java.streamingQuery()
    newest = java.offsetLog().getLatestBatchId()
    return newest.get() if newest.isDefined() else 0


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system that Spark knows; it replaces one of the same name."""
    system, file = _path(spark, path)
    stream = system.create(file, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def record_failure(query: StreamingQuery, checkpoint: str) -> Failure | None:
    """Store what made an ended query fail next to its checkpoint, one file a run, and return it."""
    from pyspark.sql import SparkSession as Session

    failure = failure_of(query)
    if failure is not None:
        spark = Session.getActiveSession() or Session.builder.getOrCreate()
        put_text(spark, f"{checkpoint}-{FOLDER}/{failure.run_id}.json", json.dumps(asdict(failure)))
    return failure


def read_failures(spark: SparkSession, checkpoint: str):
    """The stored failures of a job, of all its runs."""
    schema = "query_id string, run_id string, name string, batch long, condition string, rule string, message string"
    return spark.read.schema(schema).json(f"{checkpoint}-{FOLDER}")
