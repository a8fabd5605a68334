"""Streams that fail, start again, keep watch and keep order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import RuleFile, SingleTest, validate
from ruleloom.operators.reports import verdict_trend
from ruleloom.streaming.failures import failure_of, read_failures
from ruleloom.streaming.jobs import finish, read_files, work_folder
from ruleloom.streaming.replay import order_in_files, read_batches, write_batches
from ruleloom.streaming.status_log import StatusLog, job_status, status_rows
from ruleloom.streaming.supervisor import Supervisor, file_job

from .registry import query, table, verdicts
from .reporting import EVENT_RULES, EVENT_VERDICT

# What the sign-ups of the streams below bring: a value that the rules cannot judge.
POISONED = "CASE WHEN event_type <> 'signup' THEN value END"


class Topic:
    """A folder that files are delivered to, read as a stream, file after file."""

    def __init__(self, spark, folder, name):
        self.spark, self.path = spark, work_folder(spark, name)
        self.events, self.pieces = table(spark, folder, "events"), 0

    def deliver(self, condition="true", value="value", order=()):
        piece = self.events.where(condition).withColumn("value", F.expr(value))
        piece = piece.sortWithinPartitions(*order) if order else piece
        piece.write.parquet(f"{self.path}/piece{self.pieces}")
        self.pieces += 1
        return self

    def stream(self, files=1):
        return read_files(self.spark, f"{self.path}/*", self.events.schema, max_files_per_trigger=files)


@query("stream_jobs", """SELECT 'activity' AS job, 'finished' AS state, count(*) AS records, CAST(NULL AS VARCHAR) AS condition,
  CAST(NULL AS VARCHAR) AS rule, CAST(1 AS INTEGER) AS runs FROM events WHERE event_type IN ('view', 'click', 'error')
UNION ALL SELECT 'orders', 'failed', count(*), 'USER_RAISED_EXCEPTION', 'not small', 2 FROM events WHERE event_type = 'purchase'""")
def stream_jobs(spark, folder):
    """Two topics in one session: one ends, the other meets a record without a result, twice; the first does not mind."""
    activity = Topic(spark, folder, "topic").deliver("event_type IN ('view', 'click', 'error')")
    orders = Topic(spark, folder, "topic").deliver("event_type = 'purchase'").deliver("event_type = 'signup'", POISONED)
    out, jobs = {}, []
    for name, topic in (("activity", activity), ("orders", orders)):
        out[name] = work_folder(spark, "validated")
        jobs.append(file_job(name, lambda s, t=topic: validate(t.stream(), EVENT_RULES), out[name], work_folder(spark, "progress")))
    with Supervisor(spark, jobs) as supervisor:
        supervisor.start()
        supervisor.wait()
        supervisor.restart_failed()
        supervisor.wait()
        states = supervisor.status()
    schema = "event_id long"
    written = [read_batches(spark, path, spark.createDataFrame([], schema).schema).select(F.lit(job).alias("job")) for job, path in out.items()]
    told = [(s.name, s.state.value, s.failure and s.failure.condition, s.failure and s.failure.rule, s.runs) for s in states]
    told = spark.createDataFrame(told, "job string, state string, condition string, rule string, runs int")
    counts = written[0].unionByName(written[1]).groupBy("job").agg(F.count(F.lit(1)).alias("records"))
    return told.join(counts, "job", "left").select("job", "state", F.coalesce("records", F.lit(0)).alias("records"), "condition", "rule", "runs")


@query("stream_restart", f"""SELECT event_id, user_id, {EVENT_VERDICT} AS verdict, true AS failed_once FROM events""")
def stream_restart(spark, folder):
    """A job dies after it has written its second batch and before that is noted; the next run writes it again."""
    topic = Topic(spark, folder, "topic").deliver("event_type <> 'view'").deliver("event_type = 'view'")
    out, checkpoint = work_folder(spark, "validated"), work_folder(spark, "progress")

    def dies(batch, number):
        if number == 1:
            raise RuntimeError("the machine is lost")

    done = validate(topic.stream(), EVENT_RULES)
    query = write_batches(done, out, checkpoint, after=dies)
    try:
        query.awaitTermination()
    except Exception:
        pass
    failed = failure_of(query)
    finish(write_batches(done, out, checkpoint))
    rows = read_batches(spark, out, done.schema)
    return verdicts(rows, "event_id", "user_id").withColumn("failed_once", F.lit(failed is not None and failed.batch == 1))


_PART = "CASE WHEN event_type = 'signup' AND day(ts) % 5 = 0 THEN 3 WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END"


@query("stream_verdict_trend", f"""WITH parts AS (
  SELECT *, {_PART} AS part, date_trunc('hour', ts) AS window_start, {EVENT_VERDICT} AS verdict FROM events
), seen AS (
  SELECT part, max(max(ts)) OVER (ORDER BY part) AS latest FROM parts GROUP BY part
), kept AS (
  SELECT p.* FROM parts p LEFT JOIN seen s ON s.part = p.part - 1
  WHERE p.part = 0 OR p.window_start + INTERVAL 1 HOUR > date_trunc('millisecond', s.latest) - INTERVAL 2 DAY
)
SELECT window_start, verdict, CAST(count(*) AS BIGINT) AS records FROM kept
WHERE window_start + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 2 DAY
GROUP BY 1, 2""")
def stream_verdict_trend(spark, folder):
    """Verdicts by hour of a stream that arrives in four parts; of the last, what is over two days late is dropped."""
    topic = Topic(spark, folder, "topic")
    out, checkpoint = work_folder(spark, "trend"), work_folder(spark, "progress")
    for part in range(4):
        topic.deliver(f"{_PART} = {part}")
        trend = verdict_trend(validate(topic.stream(files=None), EVENT_RULES, details="none"), "ts", "1 hour", "2 days")
        finish(write_batches(trend, out, checkpoint))
    return read_batches(spark, out, trend.schema).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "verdict", "records")


@query("stream_status_log", """SELECT 'activity' AS name, count(*) AS records, true AS every_batch, CAST(2 AS BIGINT) AS runs,
  CAST(0 AS BIGINT) AS failures FROM events WHERE event_type <> 'purchase'
UNION ALL SELECT 'orders', count(*), true, 1, 1 FROM events WHERE event_type = 'purchase'""")
def stream_status_log(spark, folder):
    """Status rows of two jobs, one of which goes on in a second run and the other fails."""
    log = StatusLog(spark, path := work_folder(spark, "status"))
    activity = Topic(spark, folder, "topic").deliver("event_type NOT IN ('purchase', 'signup')")
    orders = Topic(spark, folder, "topic").deliver("event_type = 'purchase'").deliver("event_type = 'signup'", POISONED)
    jobs = [
        file_job(name, lambda s, t=topic: validate(t.stream(), EVENT_RULES, details="none"), work_folder(spark, "out"), work_folder(spark, "progress"))
        for name, topic in (("activity", activity), ("orders", orders))
    ]
    with Supervisor(spark, jobs) as supervisor:
        supervisor.start()
        supervisor.wait()
        activity.deliver("event_type = 'signup'")
        supervisor.start("activity")
        supervisor.wait()
    log.close()
    rows = status_rows(spark, path)
    batches = rows.groupBy("query_id").agg(
        F.count_distinct("run_id").alias("runs"), (F.count("batch") == F.max("batch") + 1).alias("every_batch"))
    return job_status(rows).join(batches, "query_id").select("name", F.col("rows").alias("records"), "every_batch", "runs", "failures")


@query("stream_first_error", f"""SELECT event_id, CASE WHEN event_type = 'signup' THEN 'FAIL' ELSE {EVENT_VERDICT} END AS verdict,
  'USER_RAISED_EXCEPTION' AS condition, 'not small' AS rule, true AS told_batch FROM events""")
def stream_first_error(spark, folder):
    """A strict job stops at its first record without a result and says where; as a permissive one it goes on from there."""
    topic = Topic(spark, folder, "topic").deliver("event_type <> 'signup'").deliver("event_type = 'signup'", POISONED)
    out, checkpoint = work_folder(spark, "validated"), work_folder(spark, "progress")
    job = file_job("events", lambda s: validate(topic.stream(), EVENT_RULES), out, checkpoint)
    with Supervisor(spark, [job]) as supervisor:
        supervisor.start()
        supervisor.wait()
        before = supervisor.status()[0]
        repaired = validate(topic.stream(), EVENT_RULES, mode="permissive")
        supervisor.replace(file_job("events", lambda s: repaired, out, checkpoint))
        supervisor.start()
        supervisor.wait()
    told = read_failures(spark, checkpoint).select("condition", "rule", (F.col("batch") == before.batches).alias("told_batch"))
    return verdicts(read_batches(spark, out, repaired.schema), "event_id").join(told)


@query("stream_ordered", """SELECT event_id % 4 AS source_partition, count(*) AS messages, min(event_id) AS first, max(event_id) AS last,
  CAST(0 AS BIGINT) AS breaks FROM events GROUP BY 1""")
def stream_ordered(spark, folder):
    """Messages of four partitions keep partition and order from the source's files to the sink's."""
    topic = Topic(spark, folder, "topic")
    for condition in ("event_id % 2 = 0", "event_id % 2 = 1"):
        topic.deliver(condition, order=("event_id",))
    messages = topic.stream().withColumn("source_partition", F.col("event_id") % 4)
    out = work_folder(spark, "validated")
    done = validate(messages, EVENT_RULES)
    finish(write_batches(done, out, work_folder(spark, "progress")))
    each = order_in_files(spark.read.schema(done.schema).parquet(out), "source_partition", "event_id")
    return each.groupBy(F.col("partition").cast("long").alias("source_partition")).agg(
        F.sum("messages").alias("messages"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("breaks").alias("breaks"))
