"""Jobs side by side, failures, replays, status rows, order, dispatch and timed samples."""

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom import RuleFile, SingleTest, validate
from ruleloom.functions.sqlfunctions import define
from ruleloom.operators.dispatch import dispatch_stream, read_dispatched, validate_dispatched
from ruleloom.operators.routing import Route, validate_routed
from ruleloom.operators.sampling import sample_within
from ruleloom.sources.rulefiles import TopicRule
from ruleloom.streaming.failures import failure_of, read_failures, record_failure
from ruleloom.streaming.jobs import finish, read_files
from ruleloom.streaming.replay import order_in_files, read_batches, write_batches
from ruleloom.streaming.status_log import StatusLog, job_status, status_rows
from ruleloom.streaming.supervisor import State, StreamJob, Supervisor, file_job

READINGS = T.StructType().add("id", "long").add("level", "double")
RULES = RuleFile.of("readings", SingleTest("level", "low", "level < 50", "WARN"))


class Inbox:
    def __init__(self, spark, path):
        self.spark, self.path, self.count = spark, str(path), 0

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), READINGS).coalesce(1).write.parquet(f"{self.path}/{self.count}")
        self.count += 1
        return self

    def read(self, rules=RULES, **options):
        return validate(read_files(self.spark, f"{self.path}/*", READINGS, max_files_per_trigger=1), rules, **options)


def ids(spark, path):
    return sorted(r["id"] for r in read_batches(spark, str(path), READINGS).collect())


def test_one_failing_job_leaves_the_others(spark, tmp_path):
    good, bad = Inbox(spark, tmp_path / "a").put((1, 2.0)).put((2, 70.0)), Inbox(spark, tmp_path / "b").put((3, 1.0)).put((4, None))
    jobs = [file_job(n, lambda s, b=b: b.read(), f"{tmp_path}/out-{n}", f"{tmp_path}/c-{n}") for n, b in (("good", good), ("bad", bad))]
    with Supervisor(spark, jobs) as supervisor:
        assert [s.state for s in supervisor.status()] == [State.NEW, State.NEW]
        supervisor.start()
        supervisor.wait()
        broken, fine = supervisor.status()
        assert (fine.state, fine.rows, fine.batches, fine.failure) == (State.FINISHED, 2, 2, None)
        assert (broken.state, broken.rows, broken.failure.batch, broken.failure.rule) == (State.FAILED, 1, 1, "low")
        assert broken.failure.condition == "USER_RAISED_EXCEPTION"
        assert supervisor.restart_failed() == ["bad"]
        supervisor.wait()
        assert supervisor.status()[0].runs == 2 and read_failures(spark, f"{tmp_path}/c-bad").count() == 2
        supervisor.replace(file_job("bad", lambda s: bad.read(mode="permissive"), f"{tmp_path}/out-bad", f"{tmp_path}/c-bad"))
        good.put((5, 5.0))
        supervisor.start()
        supervisor.wait()
        assert [(s.name, s.state, s.rows, s.runs) for s in supervisor.status()] == [
            ("bad", State.FINISHED, 2, 3), ("good", State.FINISHED, 3, 2)]
    assert ids(spark, f"{tmp_path}/out-bad") == [3, 4] and ids(spark, f"{tmp_path}/out-good") == [1, 2, 5]


def test_batches_without_rows_count(spark, tmp_path):
    inbox = Inbox(spark, tmp_path / "in").put().put((1, 1.0)).put().put((2, None))
    job = file_job("job", lambda s: inbox.read(), f"{tmp_path}/out", f"{tmp_path}/c")
    with Supervisor(spark, [job]) as supervisor:
        supervisor.start()
        supervisor.wait()
        status = supervisor.status()[0]
        assert (status.state, status.rows, status.batches, status.failure.batch) == (State.FAILED, 1, 3, 3)


def test_stop_and_restart_by_name(spark, tmp_path):
    inbox = Inbox(spark, tmp_path / "in").put((1, 1.0))
    job = file_job("steady", lambda s: inbox.read(), f"{tmp_path}/out", f"{tmp_path}/c", interval="100 milliseconds")
    with Supervisor(spark, [job]) as supervisor:
        supervisor.start("steady")
        query = supervisor._held["steady"].query
        query.processAllAvailable()
        assert supervisor.status()[0].state is State.RUNNING
        supervisor.start()  # it runs already
        assert supervisor._held["steady"].query is query
        supervisor.stop("steady")
        assert supervisor.status()[0].state is State.STOPPED and not query.isActive
        inbox.put((2, 2.0))
        supervisor.restart("steady")
        supervisor._held["steady"].query.processAllAvailable()
        assert ids(spark, f"{tmp_path}/out") == [1, 2]
    assert not spark.streams.active


def test_jobs_that_clash_or_cannot_start(spark, tmp_path):
    def fails(session):
        raise OSError("no such topic")

    inbox = Inbox(spark, tmp_path / "in").put((1, 1.0))
    with Supervisor(spark) as supervisor:
        supervisor.add(StreamJob("a", "c1", fails, TopicRule("in", "out")))
        for job in (StreamJob("a", "c2", fails), StreamJob("b", "c1", fails), StreamJob("b", "c2", fails, TopicRule("in", "other"))):
            with pytest.raises(ValueError):
                supervisor.add(job)
        supervisor.add(file_job("b", lambda s: inbox.read(), f"{tmp_path}/out", f"{tmp_path}/c"))
        with pytest.raises(ExceptionGroup):
            supervisor.start()
        supervisor.wait()
        assert [s.state for s in supervisor.status()] == [State.NEW, State.FINISHED]
        with pytest.raises(KeyError):
            supervisor.stop("unknown")


@pytest.mark.parametrize("dies_at", [0, 1, 2])
def test_a_batch_written_twice_is_there_once(spark, tmp_path, dies_at):
    inbox = Inbox(spark, tmp_path / "in").put((1, 1.0), (2, 2.0)).put((3, 3.0)).put((4, 4.0))
    out, checkpoint, died = f"{tmp_path}/out", f"{tmp_path}/c", []

    def after(batch, number):
        if number == dies_at and not died:
            died.append(batch.count())
            raise RuntimeError("gone")

    query = write_batches(inbox.read(), out, checkpoint, after=after)
    with pytest.raises(Exception, match="gone"):
        finish(query)
    assert failure_of(query).batch == dies_at and died
    finish(write_batches(inbox.read(), out, checkpoint, after=after))
    finish(write_batches(inbox.read(), out, checkpoint, after=after))
    rows = read_batches(spark, out, READINGS).collect()
    assert sorted((r["id"], r["batch"]) for r in rows) == [(1, 0), (2, 0), (3, 1), (4, 2)]


def test_no_failure_no_record(spark, tmp_path):
    query = finish(write_batches(Inbox(spark, tmp_path / "in").put((1, 1.0)).read(), f"{tmp_path}/out", f"{tmp_path}/c"))
    assert record_failure(query, f"{tmp_path}/c") is None and not (tmp_path / "c-failures").exists()


def test_status_rows_go_on_after_a_restart(spark, tmp_path):
    inbox = Inbox(spark, tmp_path / "in").put((1, 1.0), (2, 1.0)).put((3, 1.0))
    for _ in range(2):
        log = StatusLog(spark, f"{tmp_path}/log")
        with Supervisor(spark, [file_job("job", lambda s: inbox.read(), f"{tmp_path}/out", f"{tmp_path}/c")]) as supervisor:
            supervisor.start()
            supervisor.wait()
        log.close()
        assert not log.errors
        inbox.put((4, 1.0), (5, 1.0), (6, 1.0))
    rows = status_rows(spark, f"{tmp_path}/log")
    batches = rows.filter("batch IS NOT NULL").orderBy("batch").collect()
    assert [(r["batch"], r["rows"], r["name"], r["state"]) for r in batches] == [(0, 2, "job", "running"), (1, 1, "job", "running"), (2, 3, "job", "running")]
    assert all(r["ms_per_row"] > 0 and r["rows_per_second"] > 0 and r["at"] is not None for r in batches)
    assert [r["state"] for r in rows.filter("batch IS NULL").collect()] == ["ended", "ended"]
    total = job_status(rows).collect()
    assert [(r["rows"], r["batches"], r["failures"]) for r in total] == [(6, 3, 0)]


def test_batches_without_rows_have_a_status_row(spark, tmp_path):
    inbox = Inbox(spark, tmp_path / "in").put().put((1, 1.0)).put()
    log = StatusLog(spark, f"{tmp_path}/log")
    with Supervisor(spark, [file_job("job", lambda s: inbox.read(), f"{tmp_path}/out", f"{tmp_path}/c")]) as supervisor:
        supervisor.start()
        supervisor.wait()
    log.close()
    assert not log.errors
    rows = status_rows(spark, f"{tmp_path}/log")
    batches = rows.filter("batch IS NOT NULL").orderBy("batch").collect()
    assert [(r["batch"], r["rows"], r["ms_per_row"] is None) for r in batches] == [(0, 0, True), (1, 1, False), (2, 0, True)]
    assert [(r["rows"], r["batches"]) for r in job_status(rows).collect()] == [(1, 3)]


def test_breaks_of_order_are_seen(spark, tmp_path):
    def breaks(rows, name):
        spark.createDataFrame(rows, "p long, at long").coalesce(1).write.option("parquet.block.size", 1024).parquet(f"{tmp_path}/{name}")
        found = order_in_files(spark.read.parquet(f"{tmp_path}/{name}"), "p", "at").collect()
        return sorted((r["partition"] or "", r["messages"], r["first"], r["last"], r["breaks"]) for r in found)

    assert breaks([(1, 5), (2, 1), (1, 6), (2, 9), (1, 9)], "kept") == [("1", 3, 5, 9, 0), ("2", 2, 1, 9, 0)]
    assert breaks([(1, 5), (1, 5), (1, 4), (None, 1)], "broken") == [("", 1, 1, 1, 0), ("1", 3, 5, 4, 2)]
    long = [(n % 2, n) for n in range(3000)]
    long[2000], long[2002] = long[2002], long[2000]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert breaks(long, "long") == [("0", 1500, 0, 2998, 1), ("1", 1500, 1, 2999, 0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert breaks([], "none") == []


def mixed(spark, kinds):
    rows = [(n, f"kind/{n % kinds}" if n % 7 else None, None if n % 11 == 0 else json.dumps({"n": n, "x": n / 2})) for n in range(200)]
    return spark.createDataFrame([(*r, "kept") for r in rows], "key long, schema_name string, payload string, __dealt string")


def routes(kinds):
    schema = T.StructType().add("n", "long").add("x", "double")
    return {f"kind/{k}": Route(RuleFile.of(f"kind{k}", SingleTest("x", "size", f"x > {k * 10}", "WARN", "0")), schema) for k in range(kinds - 1)}


def test_dispatch_equals_routing(spark):
    df, ansi = mixed(spark, 6), spark.conf.get("spark.sql.ansi.enabled")
    for options in ({"flag": "routed"}, {"mode": "permissive", "error_column": "errors"}):
        got, want = (sorted(map(str, f(df, routes(6), **options).collect())) for f in (validate_dispatched, validate_routed))
        assert got == want and spark.conf.get("spark.sql.ansi.enabled") == ansi
    assert validate_dispatched(df.limit(0), routes(6)).columns == df.columns
    assert validate_dispatched(df.limit(0), routes(6)).count() == 0
    assert validate_dispatched(df, {}).count() == 200


def test_dispatch_of_a_stream(spark, tmp_path):
    df = mixed(spark, 4)
    for n in range(2):
        df.where(f"key % 2 = {n}").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = read_files(spark, f"{tmp_path}/in/*", df.schema, max_files_per_trigger=1)
    finish(dispatch_stream(stream, routes(4), f"{tmp_path}/out", f"{tmp_path}/c"))
    got = read_dispatched(spark, f"{tmp_path}/out", df.schema)
    assert not list((tmp_path / "out/dealt").iterdir()) and {r["batch"] for r in got.collect()} == {0, 1}
    assert sorted(map(str, got.select(df.columns).collect())) == sorted(map(str, validate_routed(df, routes(4)).collect()))


def test_plans_of_dispatch_do_not_grow_with_the_routes(spark):
    def lines(kinds):
        return len(validate_dispatched(mixed(spark, 3), routes(kinds))._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert lines(3) == lines(12)


def test_a_sample_is_back_in_time(spark):
    events = spark.range(40).selectExpr("id AS at", "id % 4 AS part")
    whole = sample_within(events, "part", [0, 1, 2, 3, 9], "at", seconds=60, last=2, max_rows=7)
    assert not whole.missing and [(r["part"], r["at"]) for r in whole.rows.collect()] == [(0, 36), (1, 37), (2, 38), (3, 39), (0, 32), (1, 33), (2, 34)]

    @F.udf("long")
    def slow(part):
        if part == 2:
            time.sleep(60)
        return part

    start = time.monotonic()
    sample = sample_within(events.withColumn("seen", slow("part")), "part", [0, 2], "at", seconds=15, last=1, jobs=1)
    assert time.monotonic() - start < 40 and sample.missing == [2]
    assert [r["at"] for r in sample.rows.collect()] == [36]
    late = sample_within(events, "part", [0, 1], "at", seconds=0)
    assert late.missing == [0, 1] and late.rows.columns == events.columns and late.rows.count() == 0


def test_sql_functions_need_no_python(spark, capsys):
    assert define(spark, "halved", {"x": "DOUBLE"}, "DOUBLE", "x / 2") == "halved"
    define(spark, "halved", {"x": "DOUBLE"}, "DOUBLE", "x / 2.0")
    df = spark.createDataFrame([(1.0, [(10.0,)]), (9.0, [(2.0,)])], "v double, l array<struct<w: double>>")
    done = validate(df, RuleFile.of("t", SingleTest("v", "small", "halved(v) < 2", "WARN", "halved(v)")))
    assert [r["v"] for r in done.collect()] == [1.0, 4.5]
    done.explain()
    assert "Python" not in capsys.readouterr().out
    with pytest.raises(ValueError):
        define(spark, "bad name", {}, "INT", "1")
