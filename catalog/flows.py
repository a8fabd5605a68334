"""Routing by schema, records in other forms, streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom import RuleFile, SingleTest, validate
from ruleloom.operators.dispatch import validate_dispatched
from ruleloom.operators.routing import UNDECODABLE, FramedJson, Route, name_schemas, validate_routed
from ruleloom.sources.records import align, frame, from_json, split_frame, to_json
from ruleloom.sources.rulefiles import TopicRule
from ruleloom.streaming.jobs import finish, read_files, with_quarantine, work_folder, write_files
from ruleloom.streaming.metrics import StreamMetrics, observe_verdicts
from ruleloom.streaming.topic_job import plan_topic, recent_messages, with_schema

from .registry import query, table, verdicts
from .reporting import EVENT_RULES, EVENT_VERDICT
from .singles import ORDER_RULES

ORDER_TYPE = (
    T.StructType().add("o_orderkey", "long").add("o_orderstatus", "string").add("o_totalprice", "double")
    .add("o_orderpriority", "string")
)
CUSTOMER_TYPE = T.StructType().add("c_custkey", "long").add("c_acctbal", "double").add("c_mktsegment", "string")
CUSTOMER_RULES = RuleFile.of(
    "customer",
    SingleTest("c_acctbal", "no debt", "c_acctbal >= 0", "WARN", "0"),
    SingleTest("c_mktsegment", "segment", "c_mktsegment <> 'FURNITURE'"),
)


def mixed_topic(spark, folder):
    """Orders, customers and suppliers as JSON records of one topic; some have no value."""

    def records(name, key, columns, dead="false"):
        df = table(spark, folder, name)
        payload = F.when(~F.expr(dead), F.to_json(F.struct(*columns)))
        return df.select(F.col(key).alias("key"), F.lit(name).alias("schema_name"), payload.alias("payload"))

    orders = records("orders", "o_orderkey", ORDER_TYPE.fieldNames(), "o_orderkey % 10 = 0")
    customers = records("customer", "c_custkey", CUSTOMER_TYPE.fieldNames())
    suppliers = records("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey"])
    return orders.unionByName(customers).unionByName(suppliers)


def _routed(spark, folder):
    routes = {"orders": Route(ORDER_RULES, ORDER_TYPE), "customer": Route(CUSTOMER_RULES, CUSTOMER_TYPE)}
    return validate_routed(mixed_topic(spark, folder), routes, flag="routed")


@query(
    "route_by_schema",
    """SELECT o_orderkey AS key, 'orders' AS schema_name, CAST(NULL AS DOUBLE) AS balance,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN NOT (o_totalprice > 0) OR o_orderpriority = '4-NOT SPECIFIED' THEN 'FAIL'
       WHEN o_orderstatus NOT IN ('F', 'O') THEN 'WARN' ELSE 'PASS' END AS verdict,
  CASE WHEN o_orderkey % 10 <> 0 THEN 'price positive' END AS first_rule FROM orders
UNION ALL SELECT c_custkey, 'customer', CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'FAIL' WHEN c_acctbal < 0 THEN 'WARN' ELSE 'PASS' END, 'no debt' FROM customer
UNION ALL SELECT s_suppkey, 'supplier', NULL, NULL, NULL FROM supplier""",
)
def route_by_schema(spark, folder):
    return _routed(spark, folder).select(
        "key",
        "schema_name",
        F.get_json_object("payload", "$.c_acctbal").cast("double").alias("balance"),
        F.get_json_object("payload", "$.__audit.__transformresult").alias("verdict"),
        F.get_json_object("payload", "$.__audit.__details[0].__transformationname").alias("first_rule"),
    )


@query(
    "route_passthrough",
    """SELECT s_suppkey AS key, 'supplier' AS schema_name,
  '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}' AS payload FROM supplier
UNION ALL SELECT o_orderkey, 'orders', NULL FROM orders WHERE o_orderkey % 10 = 0""",
)
def route_passthrough(spark, folder):
    return _routed(spark, folder).where("NOT routed").drop("routed")


_STATUS_RULES = RuleFile.of("orders", SingleTest("o_orderstatus", "open or done", "o_orderstatus <> 'P'"), SingleTest("share", "share", "100 / o_orderkey >= 1"))
_STATUS_TYPE = T.StructType().add("o_orderkey", "long").add("o_orderstatus", "string").add("share", "integer")


def _damaged(spark, folder):
    """Orders as JSON, of which some are broken, some have a field of another type and some have further fields."""
    text = """CASE o_orderkey % 5 WHEN 0 THEN concat('{"o_orderkey":', o_orderkey, ',')
      WHEN 1 THEN concat('{"o_orderkey":"no ', o_orderkey, '","o_orderstatus":"F"}')
      WHEN 2 THEN concat('{"o_orderkey":', o_orderkey, ',"o_orderstatus":"', o_orderstatus, '","note":{"by":"', o_orderpriority, '"},"flags":[1,"2"]}')
      ELSE concat('{"o_orderkey":', o_orderkey, ',"o_orderstatus":"', o_orderstatus, '","share":', o_orderkey % 7, '}') END"""
    orders = table(spark, folder, "orders")
    return orders.select(F.col("o_orderkey").alias("key"), F.lit("orders").alias("schema_name"), F.expr(text).alias("payload"))


_DAMAGED_SQL = """CASE o_orderkey % 5 WHEN 0 THEN '{"o_orderkey":' || o_orderkey || ','
  WHEN 1 THEN '{"o_orderkey":"no ' || o_orderkey || '","o_orderstatus":"F"}' END"""


def _checked(spark, folder):
    route = {"orders": Route(_STATUS_RULES, _STATUS_TYPE)}
    return validate_routed(_damaged(spark, folder), route, mode="permissive", error_column="errors", flag="routed")


@query("route_broken_payload", f"""SELECT o_orderkey AS key, {_DAMAGED_SQL} AS payload, '{UNDECODABLE}' AS errors
FROM orders WHERE o_orderkey % 5 < 2""")
def route_broken_payload(spark, folder):
    return _checked(spark, folder).where("NOT routed").select("key", "payload", F.array_join("errors", ",").alias("errors"))


@query("route_unknown_fields", """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 > 0 THEN CASE o_orderkey % 5 WHEN 1 THEN 'F' ELSE o_orderstatus END END AS status,
  CASE o_orderkey % 5 WHEN 2 THEN o_orderpriority END AS note, CASE o_orderkey % 5 WHEN 2 THEN '[1,"2"]' END AS flags,
  CASE WHEN o_orderkey % 5 < 2 THEN NULL WHEN o_orderstatus = 'P' THEN 'FAIL' WHEN o_orderkey % 5 = 2 AND o_orderkey > 100 THEN 'FAIL'
    WHEN o_orderkey % 5 > 2 AND o_orderkey > 100 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM orders""")
def route_unknown_fields(spark, folder):
    found = _checked(spark, folder)
    paths = {"status": "$.o_orderstatus", "note": "$.note.by", "flags": "$.flags", "verdict": "$.__audit.__transformresult"}
    return found.select("key", *[F.get_json_object("payload", p).alias(n) for n, p in paths.items()])


@query("route_quarantine", f"""SELECT o_orderkey AS key, o_orderkey % 5 < 2 OR o_orderkey = 0 AS held,
  CASE WHEN o_orderkey % 5 < 2 THEN '{UNDECODABLE}' WHEN o_orderkey = 0 THEN 'share' ELSE '' END AS errors FROM orders""")
def route_quarantine(spark, folder):
    done = _checked(spark, folder).withColumn("held", F.size("errors") > 0)
    out = work_folder(spark, "held")
    done.write.partitionBy("held").parquet(out)
    parted = spark.read.parquet(out)
    return parted.select("key", F.col("held").cast("boolean").alias("held"), F.array_join("errors", ",").alias("errors"))


_CLERKS = 200


@query("route_many_schemas", f"""SELECT o_orderkey AS key, 'kind' || (o_orderkey % {_CLERKS}) AS schema_name,
  CASE WHEN o_totalprice > 1000 * (o_orderkey % {_CLERKS}) THEN 'PASS' ELSE 'WARN' END AS verdict FROM orders""")
def route_many_schemas(spark, folder):
    key = F.concat(F.lit("kind"), (F.col("o_orderkey") % _CLERKS).cast("string"))
    payload = F.to_json(F.struct("o_orderkey", "o_totalprice"))
    records = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), key.alias("schema_name"), payload.alias("payload"))
    schema = T.StructType().add("o_orderkey", "long").add("o_totalprice", "double")
    routes = {
        f"kind{n}": Route(RuleFile.of(f"kind{n}", SingleTest("o_totalprice", "price", f"o_totalprice > {1000 * n}", "WARN")), schema) for n in range(_CLERKS)
    }
    done = validate_dispatched(records, routes)
    return done.select("key", "schema_name", F.get_json_object("payload", "$.__audit.__transformresult").alias("verdict"))


@query("schema_versions", """SELECT c_custkey AS key, CAST(CASE WHEN c_custkey % 3 = 2 THEN 3 ELSE 9 END AS INTEGER) AS written_id,
  CASE c_custkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN c_mktsegment END AS segment,
  CASE WHEN c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 3 = 0 OR c_nationkey > 20 THEN 'WARN' ELSE 'PASS' END AS verdict FROM customer""")
def schema_versions(spark, folder):
    customer = table(spark, folder, "customer")
    number = F.col("c_custkey") % 3 + 1
    body = F.expr("""CASE c_custkey % 3 WHEN 0 THEN to_json(struct(c_custkey, c_nationkey))
      WHEN 1 THEN to_json(struct(c_mktsegment AS segment, CAST(c_nationkey AS LONG) AS c_nationkey, c_custkey)) ELSE 'other' END""")
    framed = customer.select(F.col("c_custkey").alias("key"), frame(number.cast("int"), body.cast("binary")).alias("value"))
    old = T.StructType().add("c_custkey", "long").add("c_nationkey", "integer")
    new = T.StructType().add("segment", "string").add("c_nationkey", "long").add("c_custkey", "long")
    target = T.StructType().add("c_custkey", "long").add("c_nationkey", "long").add("segment", "string")
    rules = RuleFile.of("customer", SingleTest("segment", "known", "segment <> 'unknown'", "WARN"), SingleTest("c_nationkey", "nation", "c_nationkey <= 20", "WARN"))
    codec = FramedJson({1: ("customer", old), 2: ("customer", new)}, {"customer": 9}, {"customer": {"segment": "unknown"}})
    done = validate_routed(
        name_schemas(framed, {1: "customer", 2: "customer"}), {"customer": Route(rules, target)}, payload="value", codec=codec
    )
    parts = split_frame(done).withColumn("body", F.col("body").cast("string"))
    return parts.select(
        "key", F.col("schema_id").alias("written_id"), F.when(F.col("body") != "other", F.get_json_object("body", "$.segment")).alias("segment"),
        F.when(F.col("body") != "other", F.get_json_object("body", "$.__audit.__transformresult")).alias("verdict"),
    )


@query("sample_topic", """WITH m AS (SELECT event_id AS "offset", CAST(user_id % 7 AS INTEGER) AS partition, CAST(event_id % 3 AS INTEGER) AS id FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY "offset" DESC) AS n FROM m)
SELECT partition, "offset", CASE id WHEN 1 THEN 'events-value' END AS subject, CASE id WHEN 1 THEN '{}' END AS schema FROM r WHERE n <= 3""")
def sample_topic(spark, folder):
    messages = table(spark, folder, "events").select(
        F.lit("events").alias("topic"), (F.col("user_id") % 7).cast("int").alias("partition"), F.col("event_id").alias("offset"),
        frame((F.col("event_id") % 3).cast("int"), F.col("props").cast("binary")).alias("value"),
    )
    return with_schema(recent_messages(messages, last=3), {1: ("events-value", "{}")}).select("partition", "offset", "subject", "schema")


@query(
    "wire_frame_split",
    """SELECT event_id, CAST(70000 + user_id AS INTEGER) AS schema_id, event_type || ':' || props AS body,
  CAST(5 + length(event_type || ':' || props) AS INTEGER) AS framed_length FROM events""",
)
def wire_frame_split(spark, folder):
    body = F.concat_ws(":", "event_type", "props").cast("binary")
    framed = table(spark, folder, "events").select(
        "event_id", frame((F.col("user_id") + 70000).cast("int"), body).alias("value")
    )
    return split_frame(framed).select(
        "event_id", "schema_id", F.col("body").cast("string").alias("body"), F.length("value").alias("framed_length")
    )


@query(
    "schema_align",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, 'web' AS channel, CAST(NULL AS DOUBLE) AS rebate,
  o_orderpriority AS priority, CAST(NULL AS VARCHAR) AS carrier FROM orders""",
)
def schema_align(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.struct(F.col("o_orderpriority").alias("priority"), "o_orderdate").alias("shipping")
    )
    target = T.StructType.fromDDL(
        "o_orderkey BIGINT, o_custkey STRING, channel STRING, rebate DOUBLE, shipping STRUCT<priority: STRING, carrier: STRING>"
    )
    done = align(orders, target, {"channel": "web"})
    return done.select("o_orderkey", "o_custkey", "channel", "rebate", "shipping.priority", "shipping.carrier")


@query(
    "record_to_json",
    """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey ||
  ',"c_mktsegment":' || CASE WHEN c_nationkey = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS payload
FROM customer""",
)
def record_to_json(spark, folder):
    customer = table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.expr("CASE WHEN c_nationkey <> 0 THEN c_mktsegment END").alias("c_mktsegment"),
    )
    return to_json(customer, "payload", ["c_custkey"])


@query(
    "record_from_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS other,
  event_type, value FROM events""",
)
def record_from_json(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value", "props")
    return from_json(events, "props", T.StructType.fromDDL("k INT, other STRING"))


def _event_stream(spark, folder):
    # as a glob the path may be one file or a folder of files
    schema = table(spark, folder, "events").schema
    return read_files(spark, f"{folder}/events.parque[t]", schema)


@query("stream_validate", f"SELECT event_id, user_id, {EVENT_VERDICT} AS verdict FROM events")
def stream_validate(spark, folder):
    out, checkpoint = work_folder(spark, "validated"), work_folder(spark, "progress")
    finish(write_files(validate(_event_stream(spark, folder), EVENT_RULES), out, checkpoint))
    return verdicts(spark.read.parquet(out), "event_id", "user_id")


@query("stream_metrics", f"""SELECT count(*) AS records, count(*) FILTER (v = 'PASS') AS passed,
  count(*) FILTER (v = 'WARN') AS warned, count(*) FILTER (v = 'FAIL') AS failed, true AS timed, true AS several_batches
FROM (SELECT {EVENT_VERDICT} AS v FROM events)""")
def stream_metrics(spark, folder):
    out, checkpoint = work_folder(spark, "measured"), work_folder(spark, "progress")
    parts = work_folder(spark, "parts")
    events = table(spark, folder, "events")
    events.repartition(4, "event_id").write.parquet(parts)
    arriving = read_files(spark, parts, events.schema, max_files_per_trigger=1)
    stream = observe_verdicts(validate(arriving, EVENT_RULES, details="none"))
    metrics = StreamMetrics(spark)
    status = metrics.final(finish(write_files(stream, out, checkpoint)))
    metrics.close()
    timed = status.rows_per_second is not None and status.ms_per_row is not None and status.last_timestamp is not None
    row = (status.rows, status.passed, status.warned, status.failed, timed, status.batches > 1)
    return spark.createDataFrame([row], "records long, passed long, warned long, failed long, timed boolean, several_batches boolean")


@query(
    "stream_quarantine",
    """SELECT event_id, event_type = 'signup' AS quarantined,
  CASE WHEN event_type = 'signup' OR value <= 10 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM events""",
)
def stream_quarantine(spark, folder):
    out, checkpoint = work_folder(spark, "parted"), work_folder(spark, "progress")
    rules = RuleFile.of("events", SingleTest("value", "not small", "CASE WHEN event_type <> 'signup' THEN value > 10 END"))
    parted = with_quarantine(_event_stream(spark, folder), rules)
    finish(write_files(parted, out, checkpoint, partition_by=["quarantined"]))
    stored = spark.read.parquet(out).withColumn("quarantined", F.col("quarantined").cast("boolean"))
    return verdicts(stored, "event_id", "quarantined")




@query("topic_mapping", """SELECT c_custkey AS key, 'customer-' || CASE WHEN c_custkey % 10 = 9 THEN 'held' ELSE 'checked' END AS topic,
  CAST(c_custkey % 6 AS INTEGER) AS "partition", CASE WHEN c_custkey % 10 = 9 THEN NULL
    WHEN c_mktsegment = 'FURNITURE' THEN 'FAIL' WHEN c_acctbal < 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM customer""")
def topic_mapping(spark, folder):
    """Messages of one topic as rows of another's sink, partition kept; what cannot be decoded goes to a third."""
    rule = TopicRule("customer", "customer-checked")
    columns = F.struct("c_custkey", "c_acctbal", "c_mktsegment")
    body = F.when(F.col("c_custkey") % 10 == 9, F.lit("{")).otherwise(F.to_json(columns))
    messages = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").cast("binary").alias("key"), frame(F.lit(4), body.cast("binary")).alias("value"),
        (F.col("c_custkey") % 6).cast("int").alias("partition"), F.lit(rule.input_topic).alias("topic"))
    codec = FramedJson({4: ("customer", CUSTOMER_TYPE)}, {"customer": 5})
    rows = plan_topic(
        messages, rule, {"customer": Route(CUSTOMER_RULES, CUSTOMER_TYPE)}, {4: "customer"}, codec, input_partitions=6, output_partitions=6,
        quarantine_topic="customer-held")
    verdict = F.get_json_object(codec.text(F.col("value")), "$.__audit.__transformresult")
    return rows.select(F.col("key").cast("string").cast("long").alias("key"), "topic", "partition", verdict.alias("verdict"))
