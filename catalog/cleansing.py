"""Changed values: snapshot within a step, last change wins, steps in sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import ArrayOf, RecordOf, RuleFile, SingleTest, Step, validate

from .registry import query, table, verdicts
from .singles import orders_with_shipping


@query(
    "rule_substitute",
    """SELECT o_orderkey,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '5-LOW' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_totalprice <= 300000 THEN o_totalprice ELSE 300000 END AS o_totalprice,
  CASE WHEN o_totalprice > 300000 THEN 'WARN' ELSE 'PASS' END AS verdict
FROM orders""",
)
def rule_substitute(spark, folder):
    rules = RuleFile.of(
        "orders",
        SingleTest("o_orderpriority", "no default", "o_orderpriority <> '4-NOT SPECIFIED'", "PASS", "'5-LOW'"),
        SingleTest("o_totalprice", "capped", "o_totalprice <= 300000", "WARN", "300000"),
    )
    done = validate(table(spark, folder, "orders"), rules, details="none")
    return verdicts(done, "o_orderkey", "o_orderpriority", "o_totalprice")


@query(
    "substitute_snapshot",
    """SELECT event_id,
  CASE WHEN event_type = 'view' THEN 'click' ELSE event_type END AS event_type,
  CASE WHEN event_type = 'click' THEN 1 ELSE value END AS value,
  CASE WHEN event_type <> 'view' AND event_type <> 'click' THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM events""",
)
def substitute_snapshot(spark, folder):
    # the second test still sees 'view', although the first one changes it
    rules = RuleFile.of(
        "events",
        SingleTest("event_type", "no views", "event_type <> 'view'", "FAIL", "'click'"),
        SingleTest("value", "clicks count one", "event_type <> 'click'", "FAIL", "1"),
    )
    return verdicts(validate(table(spark, folder, "events"), rules), "event_id", "event_type", "value")


@query(
    "substitute_last_wins",
    """SELECT l_orderkey, l_linenumber, l_extendedprice,
  CASE WHEN l_quantity > 40 THEN NULL WHEN l_quantity > 20 THEN 20 ELSE l_quantity END AS l_quantity
FROM lineitem""",
)
def substitute_last_wins(spark, folder):
    rules = RuleFile.of(
        "lineitem",
        SingleTest("l_quantity", "at most 20", "l_quantity <= 20", "WARN", "20"),
        SingleTest("l_quantity", "at most 40", "l_quantity <= 40", "FAIL", "NULL"),
    )
    done = validate(table(spark, folder, "lineitem"), rules, details="none")
    return done.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


@query(
    "rule_steps_chain",
    """SELECT c_custkey, seg AS c_mktsegment, bal AS c_acctbal, CASE WHEN bal > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CAST(4 AS INTEGER) AS tests
FROM (SELECT *, CASE WHEN seg = 'building' THEN c_acctbal + 1000 ELSE c_acctbal END AS bal
      FROM (SELECT *, lower(c_mktsegment) AS seg FROM customer))""",
)
def rule_steps_chain(spark, folder):
    rules = RuleFile(
        "customer",
        (
            Step("standardise", [SingleTest("c_mktsegment", "lower case", "c_mktsegment = lower(c_mktsegment)", "PASS", "lower(c_mktsegment)")]),
            Step("adjust", [SingleTest("c_acctbal", "credit", "c_mktsegment <> 'building'", "PASS", "c_acctbal + 1000")]),
            Step("check", [
                SingleTest("c_acctbal", "positive", "c_acctbal > 0"),
                SingleTest("c_mktsegment", "is lower", "c_mktsegment = lower(c_mktsegment)"),
            ]),
        ),
    )
    done = validate(table(spark, folder, "customer"), rules)
    return verdicts(done.withColumn("tests", F.size("__audit.__details")), "c_custkey", "c_mktsegment", "c_acctbal", "tests")


@query(
    "substitute_nested_record",
    """SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority LIKE '4-%' THEN '9-' || o_orderstatus
       ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price,
  o_orderstatus = 'P' AS no_record
FROM orders""",
)
def substitute_nested_record(spark, folder):
    rules = RuleFile.of(
        "orders",
        RecordOf("shipping", [SingleTest("priority", "given", "{priority} NOT LIKE '4-%'", "WARN", "concat('9-', {parent.o_orderstatus})")]),
    )
    done = validate(orders_with_shipping(spark, folder), rules, details="none")
    return done.select("o_orderkey", "shipping.priority", "shipping.price", F.col("shipping").isNull().alias("no_record"))


def lines_of_documents(spark, folder):
    """Documents with their whole text as an array of line records."""
    lines = "transform(split(text, '\\n'), x -> named_struct('line', x, 'size', length(x)))"
    return table(spark, folder, "documents").select("doc_id", "lang", "source", F.expr(lines).alias("lines"))


@query(
    "substitute_in_array",
    """SELECT doc_id, CAST(n - 1 AS INTEGER) AS n,
  CASE WHEN length(line) = 0 THEN '(empty, ' || lang || ')' ELSE line END AS line,
  CAST(length(line) AS INTEGER) AS size
FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
             unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)""",
)
def substitute_in_array(spark, folder):
    rules = RuleFile.of(
        "documents",
        ArrayOf("lines", [SingleTest("line", "not empty", "{size} > 0", "WARN", "concat('(empty, ', {parent.parent.lang}, ')')")]),
    )
    done = validate(lines_of_documents(spark, folder), rules, details="none")
    return done.select("doc_id", F.posexplode_outer("lines").alias("n", "l")).select("doc_id", "n", "l.line", "l.size")
