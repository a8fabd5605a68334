"""Routing, streams, records in other forms, samples."""

import json

import pytest
from audit_helpers import details, verdict
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom import RuleFile, SingleTest, Step, validate
from ruleloom.operators.reports import verdict_trend, write_split
from ruleloom.operators.routing import UNDECODABLE, FramedAvro, FramedJson, Route, name_schemas, validate_routed
from ruleloom.operators.sampling import sample_payload, sample_recent
from ruleloom.session import SETTINGS, tune
from ruleloom.sources import kafka
from ruleloom.sources.records import align, frame, from_json, split_frame, to_json
from ruleloom.sources.rulefiles import TopicRule
from ruleloom.streaming.jobs import ERRORS, finish, read_files, validate_topic, with_quarantine, work_folder, write_files
from ruleloom.streaming.metrics import StreamMetrics, observe_verdicts
from ruleloom.streaming.topic_job import plan_topic, recent_messages, topic_routes, with_schema

EVENTS = "/root/testdata/sf0.001/events.parquet"
RULES = RuleFile.of(
    "events", SingleTest("value", "not small", "value > 10", "WARN"), SingleTest("event_type", "no errors", "event_type <> 'error'")
)


def plain(df):
    return sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect())


# -- routing -------------------------------------------------------------------


def test_routing_with_conflicting_types(spark):
    df = spark.createDataFrame(
        [
            ("A", '{"id": 1, "value": 5}', 10),
            ("B", '{"id": "x", "value": 50}', 11),
            ("C", '{"free":  1}', 12),
            ("A", None, 13),
            (None, '{"id": 1}', 14),
        ],
        "schema_name string, payload string, offset int",
    )
    test = SingleTest("value", "big", "value > 10", "WARN", "11")
    routes = {
        "A": Route(RuleFile.of("a", test), T.StructType().add("id", "integer").add("value", "integer")),
        "B": Route(RuleFile.of("b", test), T.StructType().add("id", "string").add("value", "integer")),
        "C": Route(RuleFile("c"), T.StructType().add("free", "integer")),
    }
    out = validate_routed(df, routes, flag="routed").orderBy("offset").collect()
    first, second = json.loads(out[0]["payload"]), json.loads(out[1]["payload"])
    assert (first["id"], first["value"], first["__audit"]["__transformresult"]) == (1, 11, "WARN")
    assert (second["id"], second["value"], second["__audit"]["__transformresult"]) == ("x", 50, "PASS")
    assert first["__audit"]["__details"] == [
        {"__transformationname": "big", "__transformresult": "WARN", "__transformresult_text": "value", "__transformresult_quality": 90}
    ]
    assert [r["payload"] for r in out[2:]] == ['{"free":  1}', None, '{"id": 1}']
    assert [r["routed"] for r in out] == [True, True, False, False, False]


def test_routing_keeps_existing_audits_and_deletes(spark):
    audit = T.StructType.fromDDL(
        "__transformresult STRING, __details ARRAY<STRUCT<__transformationname: STRING, __transformresult: STRING,"
        " __transformresult_text: STRING, __transformresult_quality: TINYINT>>"
    )
    schema = T.StructType().add("__change_type", "string").add("v", "integer").add("__audit", audit)
    rows = [
        ("A", '{"__change_type": "I", "v": 1, "__audit": {"__transformresult": "WARN", "__details": []}}'),
        ("A", '{"__change_type": "D", "v": 1}'),
    ]
    df = spark.createDataFrame(rows, "schema_name string, payload string")
    out = validate_routed(df, {"A": Route(RuleFile.of("a", SingleTest("v", "r", "v > 0")), schema)}).collect()
    first, second = (json.loads(r["payload"]) for r in out)
    assert first["__audit"]["__transformresult"] == "WARN" and len(first["__audit"]["__details"]) == 1
    assert second == {"__change_type": "D", "v": 1, "__audit": None}


def test_routing_stops_on_broken_records(spark):
    df = spark.createDataFrame([("A", "{broken")], "schema_name string, payload string")
    routes = {"A": Route(RuleFile.of("a", SingleTest("v", "r", "v > 0")), T.StructType().add("v", "integer"))}
    with pytest.raises(Exception, match="(?i)malformed"):
        validate_routed(df, routes).collect()


def test_routing_scans_once_and_does_not_shuffle(spark, tmp_path):
    spark.range(10).select(F.lit("A").alias("schema_name"), F.to_json(F.struct("id")).alias("payload")).write.parquet(f"{tmp_path}/in")
    schema = T.StructType().add("id", "long")
    routes = {n: Route(RuleFile.of(n, SingleTest("id", "r", "id > 0")), schema) for n in "ABCDE"}
    plan = validate_routed(spark.read.parquet(f"{tmp_path}/in"), routes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_topic_messages(spark):
    body = F.to_json(F.struct("id")).cast("binary")
    framed = spark.range(3).select(
        F.lit(bytearray(b"k")).alias("key"), frame((F.col("id") + 7).cast("int"), body).alias("value"),
        F.lit("in").alias("topic"), F.lit(4).alias("partition"), F.col("id").alias("offset"),
    )
    routes = {"A": Route(RuleFile.of("a", SingleTest("id", "r", "id > 5", "WARN")), T.StructType().add("id", "long"))}
    codec = FramedJson({7: ("A", routes["A"].schema), 9: ("A", routes["A"].schema)}, {"A": 9})
    out = validate_topic(framed, routes, {7: "A", 8: "B"}, codec, "out")
    assert out.columns == ["key", "value", "topic", "partition"]
    rows = out.collect()
    changed = [json.loads(bytes(r["value"])[5:]) for r in rows]
    assert bytes(rows[0]["value"])[:5] == b"\x00\x00\x00\x00\x09"
    assert changed[0]["__audit"]["__transformresult"] == "WARN"
    assert [bytes(r["value"]) for r in rows[1:]] == [b'\x00\x00\x00\x00\x08{"id":1}', b'\x00\x00\x00\x00\x09{"id":2}']
    assert {(r["topic"], r["partition"]) for r in rows} == {("out", 4)}


def test_routing_keeps_unknown_fields(spark):
    df = spark.createDataFrame([("A", '{"v":1,"extra":{"a":[1,"x"]},"text":"5"}'), ("A", '{"v":2}')], "schema_name string, payload string")
    routes = {"A": Route(RuleFile.of("a", SingleTest("v", "r", "v > 0")), T.StructType().add("v", "integer"))}
    first, second = (json.loads(r["payload"]) for r in validate_routed(df, routes).collect())
    assert (first["v"], first["extra"], first["text"]) == (1, {"a": [1, "x"]}, "5") and "extra" not in second
    with pytest.raises(Exception, match="extra"):
        validate_routed(df, routes, unknown="refuse").collect()
    held = validate_routed(df, routes, unknown="refuse", mode="permissive", error_column="e").collect()
    assert held[0]["e"] == [UNDECODABLE] and held[0]["payload"] == df.first()["payload"] and held[1]["e"] == []
    assert "extra" not in validate_routed(df, routes, unknown="drop").first()["payload"]


def test_routing_keeps_what_it_cannot_decode(spark):
    broken = ["{broken", '{"v":"notint","keep":"me"}', "null", "[]"]
    df = spark.createDataFrame([("A", p) for p in [*broken, '{"v":5}']], "schema_name string, payload string")
    routes = {"A": Route(RuleFile.of("a", SingleTest("v", "r", "10 / v > 1")), T.StructType().add("v", "integer"))}
    out = validate_routed(df, routes, mode="permissive", error_column="errors", flag="routed").collect()
    assert [r["payload"] for r in out[:4]] == broken and [r["routed"] for r in out] == [False] * 4 + [True]
    assert [r["errors"] for r in out] == [[UNDECODABLE]] * 4 + [[]]
    for name in ("payload", "routed"):
        with pytest.raises(ValueError, match="already"):
            validate_routed(df.withColumn("routed", F.lit(1)), routes, mode="permissive", error_column=name)


def test_routes_with_names_that_differ_in_case(spark):
    df = spark.createDataFrame([("A", '{"Id":1}'), ("B", '{"id":2}')], "schema_name string, payload string")
    routes = {n: Route(RuleFile.of(n, SingleTest(f, "r", f"{f} > 1")), T.StructType().add(f, "integer")) for n, f in (("A", "Id"), ("B", "id"))}
    out = [json.loads(r["payload"]) for r in validate_routed(df, routes).collect()]
    assert (out[0]["Id"], out[0]["__audit"]["__transformresult"], out[1]["id"], out[1]["__audit"]["__transformresult"]) == (1, "FAIL", 2, "PASS")


def test_schema_versions_of_one_topic(spark):
    old, new = T.StructType().add("id", "integer"), T.StructType().add("name", "string").add("id", "long")
    target = T.StructType().add("id", "long").add("name", "string")
    rows = [(1, '{"id":1}'), (2, '{"name":"x","id":2}'), (3, '{"id":3}'), (1, "{broken")]
    df = spark.createDataFrame(rows, "n int, body string").select(frame(F.col("n"), F.col("body").cast("binary")).alias("value"))
    codec = FramedJson({1: ("A", old), 2: ("A", new)}, {"A": 9}, {"A": {"name": "none"}})
    routes = {"A": Route(RuleFile.of("a", SingleTest("name", "r", "name <> 'none'", "WARN")), target)}
    out = validate_routed(name_schemas(df, {1: "A", 2: "A"}), routes, payload="value", codec=codec, mode="permissive", error_column="e").collect()
    first, second = (json.loads(bytes(r["value"])[5:]) for r in out[:2])
    assert (first["id"], first["name"], first["__audit"]["__transformresult"]) == (1, "none", "WARN")
    assert (second["id"], second["name"], second["__audit"]["__transformresult"]) == (2, "x", "PASS")
    assert bytes(out[2]["value"]) == b'\x00\x00\x00\x00\x03{"id":3}' and out[2]["schema_name"] is None
    assert bytes(out[3]["value"])[5:] == b"{broken" and [r["e"] for r in out] == [[], [], [], [UNDECODABLE]]


def test_framed_avro_uses_the_writers_schema(spark, monkeypatch):
    calls = []

    class Avro:
        @staticmethod
        def from_avro(body, schema, options):
            calls.append((json.loads(schema)["fields"], options["avroSchema"]))
            return F.from_json(body.cast("string"), "v int")

        @staticmethod
        def to_avro(record, schema):
            calls.append(json.loads(schema)["name"])
            return F.to_json(record).cast("binary")

    monkeypatch.setattr("ruleloom.operators.routing.avro_functions", lambda: Avro)
    writers = {n: json.dumps({"type": "record", "name": "x.R", "fields": [{"name": "v", "type": t}]}) for n, t in ((1, "int"), (2, "long"))}
    reader = writers[2]
    df = spark.createDataFrame([(1, '{"v":1}'), (2, '{"v":2}')], "n int, body string")
    df = df.select(frame(F.col("n"), F.col("body").cast("binary")).alias("value"), F.lit("x.R").alias("schema_name"))
    routes = {"x.R": Route(RuleFile.of("r", SingleTest("v", "t", "v > 1")), T.StructType().add("v", "integer"), reader)}
    out = validate_routed(df, routes, payload="value", codec=FramedAvro(writers, {"x.R": 7})).collect()
    assert [json.loads(bytes(r["value"])[5:])["__audit"]["__transformresult"] for r in out] == ["FAIL", "PASS"]
    assert calls == [([{"name": "v", "type": "int"}], reader), ([{"name": "v", "type": "long"}], reader), "x.R_CLEANSED"]


def test_topic_job_from_settings(spark, tmp_path):
    avro = json.dumps({"type": "record", "name": "R", "namespace": "x", "fields": [{"name": "v", "type": "int"}]})
    file = {"schema": avro, "rulesteps": [{"fieldname": "step", "rules": [
        {"type": "PrimitiveRule", "fieldname": "v", "rulename": "positive", "condition": "10 / v > 0", "iffalse": "FAIL"}]}]}
    (tmp_path / "s/active").mkdir(parents=True)
    (tmp_path / "s/active/one.json").write_text(json.dumps(file))
    rule = TopicRule("in", "out", ("s/one.json", "s/not active.json"))
    routes = topic_routes(rule, tmp_path)
    assert list(routes) == ["x.R"] and routes["x.R"].schema == T.StructType([T.StructField("v", T.IntegerType(), False)])
    with pytest.raises(FileNotFoundError):
        topic_routes(TopicRule("in", "out", ("s/not active.json",)), tmp_path)
    rows = [(4, '{"v":1}', 0), (4, '{"v":0}', 1), (4, "{", 2), (5, "other", 3)]
    messages = spark.createDataFrame(rows, "n int, body string, offset long").select(
        F.lit(b"k").alias("key"), frame(F.col("n"), F.col("body").cast("binary")).alias("value"), F.lit("in").alias("topic"), F.lit(2).alias("partition"), "offset"
    )
    messages.write.parquet(f"{tmp_path}/topic")
    codec = FramedJson({4: ("x.R", routes["x.R"].schema)}, {"x.R": 6})
    stream = read_files(spark, f"{tmp_path}/topic", messages.schema)
    options = {"quarantine_topic": "bad", "input_partitions": 3}
    out = plan_topic(stream, rule, routes, {4: "x.R"}, codec, output_partitions=3, **options)
    assert "partition" in out.columns
    assert "partition" not in plan_topic(stream, rule, routes, {4: "x.R"}, codec, output_partitions=5, **options).columns
    finish(write_files(out, f"{tmp_path}/out", f"{tmp_path}/c"))
    got = {bytes(r["value"])[5:12]: r["topic"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {b'{"v":1,': "out", b'{"v":0,': "bad", b"{": "bad", b"other": "out"}


def test_recent_messages_with_subject_and_schema(spark):
    df = spark.range(40).select(
        F.lit("t").alias("topic"), (F.col("id") % 2).cast("int").alias("partition"), F.col("id").alias("offset"), frame((F.col("id") % 3).cast("int"), F.lit(b"x")).alias("value")
    )
    rows = with_schema(recent_messages(df, last=2), {0: ("s-value", "{}")}).collect()
    assert [r["offset"] for r in rows] == [38, 39, 36, 37]
    assert [(r["subject"], r["schema"]) for r in rows] == [(None, None), ("s-value", "{}"), ("s-value", "{}"), (None, None)]


# -- streams -------------------------------------------------------------------


def event_parts(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    for n in range(3):
        events.where(F.col("event_id") % 3 == n).coalesce(1).write.parquet(f"{tmp_path}/in/part{n}")
    return events, f"{tmp_path}/in/*"


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    events, _ = event_parts(spark, tmp_path)
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def run():
        stream = read_files(spark, f"{tmp_path}/in/*", events.schema, max_files_per_trigger=1)
        finish(write_files(validate(stream, RULES), out, checkpoint))
        return spark.read.parquet(out)

    assert plain(run()) == plain(validate(events, RULES))
    assert run().count() == events.count()  # nothing new, nothing twice
    extra = events.limit(5).withColumn("event_id", F.col("event_id") + 1000000)
    extra.coalesce(1).write.parquet(f"{tmp_path}/in/later")
    assert run().count() == events.count() + 5


def test_strict_stream_fails_and_keeps_the_error(spark, tmp_path):
    events, path = event_parts(spark, tmp_path)
    bad = RuleFile.of("events", SingleTest("value", "r", "nullif(value, value) > 0"))
    metrics = StreamMetrics(spark)
    query = write_files(validate(read_files(spark, path, events.schema), bad), f"{tmp_path}/out", f"{tmp_path}/c")
    with pytest.raises(Exception, match="neither true nor false"):
        finish(query)
    assert "neither true" in metrics.final(query).error
    metrics.close()


def test_quarantine_parts_rows_in_one_write(spark, tmp_path):
    events, path = event_parts(spark, tmp_path)
    rules = RuleFile.of("events", SingleTest("value", "r", "CASE WHEN event_type <> 'signup' THEN value > 0 END"))
    stream = with_quarantine(read_files(spark, path, events.schema), rules)
    finish(write_files(stream, f"{tmp_path}/out", f"{tmp_path}/c", partition_by=["quarantined"]))
    held = spark.read.parquet(f"{tmp_path}/out/quarantined=true")
    assert held.count() == events.where("event_type = 'signup'").count()
    assert held.select(ERRORS).distinct().collect()[0][0] == ["r"]
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()


def test_metrics(spark, tmp_path):
    events, path = event_parts(spark, tmp_path)
    stream = observe_verdicts(validate(read_files(spark, path, events.schema, max_files_per_trigger=1), RULES, details="none"))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)  # fewer than there are batches
    metrics = StreamMetrics(spark)
    try:
        status = metrics.final(finish(write_files(stream, f"{tmp_path}/out", f"{tmp_path}/c")))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        metrics.close()
    assert status.batches == 3
    assert status.rows == events.count() == status.passed + status.warned + status.failed
    assert status.failed == events.where("event_type = 'error'").count()
    assert status.rows_per_second > 0 and status.ms_per_row > 0 and status.error is None


def test_trend_of_a_stream(spark, tmp_path):
    events, path = event_parts(spark, tmp_path)
    stream = verdict_trend(validate(read_files(spark, path, events.schema), RULES, details="none"), "ts", "1 hour", "10 minutes")
    query = stream.writeStream.format("memory").queryName("trend").outputMode("complete").trigger(availableNow=True).start()
    finish(query)
    batch = verdict_trend(validate(events, RULES, details="none"), "ts", "1 hour")
    assert plain(spark.table("trend")) == plain(batch.withColumn("window_start", F.col("window_start").cast("timestamp")))


def test_work_folder_is_inside_the_shared_folder(spark):
    assert work_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert work_folder(spark, "x") != work_folder(spark, "x")


def test_kafka_columns(spark):
    df = spark.createDataFrame([(b"k", b"v", 3, True)], "key binary, value binary, partition int, bad boolean")
    out = kafka.sink_columns(df, F.when(F.col("bad"), "quarantine").otherwise("clean"), partition="partition").first()
    assert (bytes(out.key), bytes(out.value), out.topic, out.partition) == (b"k", b"v", "quarantine", 3)
    assert json.loads(kafka.recent_offsets({"t": {0: 25, 1: 4}})) == {"t": {"0": 15, "1": 0}}
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka.read_topic(spark, TopicRule("in", "out"), "nowhere:1")


# -- records and samples ------------------------------------------------------------


def test_frames(spark):
    df = spark.createDataFrame([(bytearray(b"body"), 2**31 - 1), (bytearray(b""), 1)], "b binary, id int")
    framed = df.select(frame(F.col("id"), F.col("b")).alias("value"))
    assert bytes(framed.first()[0]) == b"\x00\x7f\xff\xff\xffbody"
    parts = split_frame(framed).collect()
    assert [(r["schema_id"], bytes(r["body"])) for r in parts] == [(2**31 - 1, b"body"), (1, b"")]
    for bad in (b"\x01\x00\x00\x00\x01x", b"\x00\x00"):
        with pytest.raises(Exception, match="zero byte"):
            split_frame(spark.createDataFrame([(bytearray(bad),)], "value binary")).collect()
    assert split_frame(spark.createDataFrame([(None,)], "value binary")).first()["schema_id"] is None


def test_json_round_trip(spark):
    schema = T.StructType.fromDDL("id INT, r STRUCT<x: STRING, l: ARRAY<DOUBLE>>, m MAP<STRING, INT>")
    df = spark.createDataFrame([(1, ("a", [1.5]), {"k": 1}), (2, None, None)], schema)
    assert plain(from_json(to_json(df), "payload", schema)) == plain(df)
    assert json.loads(to_json(df).collect()[1]["payload"]) == {"id": 2, "r": None, "m": None}


def test_align_nested(spark):
    df = spark.createDataFrame([(1, [(1, "gone"), None], 5)], "id int, l array<struct<x: int, old: string>>, drop int")
    target = T.StructType.fromDDL("l ARRAY<STRUCT<added: STRING, x: BIGINT>>, id STRING, n INT, d STRING")
    out = align(df, target, {"d": "default"})
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in target.fields]
    assert out.first().asDict(True) == {"l": [{"added": None, "x": 1}, None], "id": "1", "n": None, "d": "default"}


def test_sample_recent_with_a_dominant_partition(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 20 + 1).cast("int").alias("p"), "id")
    sample = sample_recent(df, ["p"], "id")
    rows = sample.collect()
    assert len(rows) == 100 and rows[0]["id"] == 899
    # 21 partitions: each gives its four newest before any gives more
    assert sum(r["p"] == 0 for r in rows) == 5 and len({r["p"] for r in rows}) == 21
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()
    payload = sample_payload(sample.withColumn("t", F.lit("topic")), "t", "p", "id", ["p", "id"]).first()
    assert payload["filename"] == "partition_0_offset_899.json" and json.loads(payload["payload"]) == {"p": 0, "id": 899}


def test_write_split(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    write_split(validate(events, RULES), f"{tmp_path}/split")
    assert spark.read.parquet(f"{tmp_path}/split/verdict=FAIL").count() == events.where("event_type = 'error'").count()
    assert spark.read.parquet(f"{tmp_path}/split").count() == events.count()


# -- plans --------------------------------------------------------------------------


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_are_narrow_and_pruned(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    rules = RuleFile(
        "orders",
        (
            Step("one", [SingleTest("o_totalprice", "price", "o_totalprice > 0", "WARN", "0")]),
            Step("two", [SingleTest("o_orderstatus", "status", "o_orderstatus <> 'P'")]),
        ),
    )
    out = validate(orders, rules)
    plan = executed(out)
    assert not any(word in plan for word in ("Exchange", "Python", "Sort", "Join", "Aggregate"))
    only_verdict = executed(out.select("o_orderkey", F.col("__audit.__transformresult")))
    assert "o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in only_verdict
    assert "__transformationname" not in only_verdict and "status,PASS" not in only_verdict
    filtered = executed(out.where("o_orderkey = 5"))
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in filtered


def test_exploded_details_evaluate_rules_once(spark):
    from ruleloom.operators.reports import audit_rows

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    rules = RuleFile.of("orders", SingleTest("o_totalprice", "price", "o_totalprice > 4321"))
    assert executed(audit_rows(validate(orders, rules), ["o_orderkey"])).count("> 4321.0") == 1


def test_many_steps_do_not_blow_up_the_plan(spark):
    steps = [Step(f"s{n}", [SingleTest("v", f"r{n}", "v + v > 0", "PASS", "v + v + 1")]) for n in range(15)]
    out = validate(spark.range(3).selectExpr("CAST(id AS DOUBLE) AS v"), RuleFile("t", steps))
    assert len(executed(out)) < 100_000
    assert [len(details(r)) for r in out.collect()] == [15, 15, 15] and verdict(out.first()) == "PASS"


def test_session_settings(spark, recwarn):
    many = RuleFile.of("t", *[SingleTest("id", f"r{n}", f"id > {n}") for n in range(30)])
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    with pytest.warns(UserWarning, match="tune"):
        validate(spark.range(1), many)
    tune(spark)
    assert all(spark.conf.get(k) == v for k, v in SETTINGS.items())
    recwarn.clear()
    assert len(details(validate(spark.range(1), many).first())) == 30
    assert not [w for w in recwarn.list if "tune" in str(w.message)]
