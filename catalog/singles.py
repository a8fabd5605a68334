"""Single tests, severities, generic rules, nested records, unions, gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ruleloom import Generic, RecordOf, RuleFile, SingleTest, UnionOf, validate
from ruleloom.functions.sqlfunctions import define
from ruleloom.sources.rulefiles import parse_rule_file

from .registry import flat, query, table, test, union, verdicts

ORDER_RULES = RuleFile.of(
    "orders",
    SingleTest("o_totalprice", "price positive", "o_totalprice > 0"),
    SingleTest("o_orderstatus", "known status", "o_orderstatus IN ('F', 'O')", "WARN"),
    SingleTest("o_orderpriority", "priority given", "o_orderpriority <> '4-NOT SPECIFIED'", "FAIL"),
)
ORDER_RULES_SQL = union(
    test("orders", "o_orderkey", "price positive", "o_totalprice > 0", "o_totalprice"),
    test("orders", "o_orderkey", "known status", "o_orderstatus IN ('F', 'O')", "o_orderstatus", "WARN"),
    test("orders", "o_orderkey", "priority given", "o_orderpriority <> '4-NOT SPECIFIED'", "o_orderpriority"),
)


@query("rule_single_test", test("orders", "o_orderkey", "large order", "o_totalprice > 100000", "o_totalprice"))
def rule_single_test(spark, folder):
    rules = RuleFile.of("orders", SingleTest("o_totalprice", "large order", "o_totalprice > 100000"))
    return flat(validate(table(spark, folder, "orders"), rules), "o_orderkey")


@query(
    "rule_severity_levels",
    union(
        *[
            test("lineitem", "l_orderkey, l_linenumber", f"few as {s.lower()}", "l_quantity <= 25", "l_quantity", s)
            for s in ("FAIL", "WARN", "PASS")
        ]
    ),
)
def rule_severity_levels(spark, folder):
    tests = [SingleTest("l_quantity", f"few as {s.lower()}", "l_quantity <= 25", s) for s in ("FAIL", "WARN", "PASS")]
    return flat(validate(table(spark, folder, "lineitem"), RuleFile.of("lineitem", *tests)), "l_orderkey", "l_linenumber")


@query(
    "rule_generic",
    union(
        test("lineitem", "l_orderkey, l_linenumber", "unit price", "l_extendedprice / l_quantity < 1500", None, "WARN"),
        test("lineitem", "l_orderkey, l_linenumber", "flag fits status",
             "l_returnflag <> 'N' OR l_linestatus = 'O'", None),
    ),
)
def rule_generic(spark, folder):
    rules = RuleFile.of(
        "lineitem",
        Generic(
            [
                SingleTest(None, "unit price", "l_extendedprice / l_quantity < 1500", "WARN"),
                SingleTest(None, "flag fits status", "l_returnflag <> 'N' OR l_linestatus = 'O'"),
            ]
        ),
    )
    return flat(validate(table(spark, folder, "lineitem"), rules), "l_orderkey", "l_linenumber")


# Keys, "type" names and "(more)" are the file format: fixed values.
SKELETON = """{"name": "orders", "rulesteps": [{"type": "RuleStep", "fieldname": "to be written", "rules": [
  {"type": "EmptyRule", "fieldname": "o_orderkey", "rules": null, "samplevalue": null},
  {"type": "RecordRule", "fieldname": "price", "rules": [
    {"type": "EmptyRule", "fieldname": "total"}, {"type": "GenericRules", "fieldname": "(more)", "rules": null}]},
  {"type": "GenericRules", "fieldname": "(more)", "rules": null}]}]}"""


@query(
    "rule_skeleton_noop",
    "SELECT o_orderkey, 'PASS' AS verdict, CAST(0 AS INTEGER) AS tests FROM orders",
)
def rule_skeleton_noop(spark, folder):
    orders = table(spark, folder, "orders").withColumn("price", F.struct(F.col("o_totalprice").alias("total")))
    done = validate(orders, parse_rule_file(SKELETON))
    return verdicts(done.withColumn("tests", F.size("__audit.__details")), "o_orderkey", "tests")


def orders_with_shipping(spark, folder):
    """Orders with a nested record; the record is NULL for pending orders."""
    record = "CASE WHEN o_orderstatus <> 'P' THEN named_struct('priority', o_orderpriority, 'price', o_totalprice) END"
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.expr(record).alias("shipping"))


def _shipping_rules():
    return RuleFile.of(
        "orders",
        RecordOf(
            "shipping",
            [
                SingleTest("priority", "urgent", "{priority} LIKE '1-%' OR {priority} LIKE '2-%'", "WARN"),
                SingleTest("price", "price fits status", "{price} > 50000 OR {parent.o_orderstatus} = 'F'"),
                Generic([SingleTest(None, "both", "{priority} IS NOT NULL AND {price} > 1000")]),
            ],
        ),
    )


_URGENT = "o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%'"
_FITS = "o_totalprice > 50000 OR o_orderstatus = 'F'"
_NESTED = "o_orderstatus <> 'P'"


@query(
    "rule_nested_record",
    union(
        test("orders", "o_orderkey", "urgent", _URGENT, "shipping.priority", "WARN", _NESTED),
        test("orders", "o_orderkey", "price fits status", _FITS, "shipping.price", "FAIL", _NESTED),
        test("orders", "o_orderkey", "both", "o_totalprice > 1000", "shipping", "FAIL", _NESTED),
    ),
)
def rule_nested_record(spark, folder):
    return flat(validate(orders_with_shipping(spark, folder), _shipping_rules()), "o_orderkey")


@query(
    "rule_nested_record_enclosing",
    union(
        test("orders", "o_orderkey", "urgent", _URGENT, "priority", "WARN", _NESTED),
        test("orders", "o_orderkey", "price fits status", _FITS, "price", "FAIL", _NESTED),
        test("orders", "o_orderkey", "both", "o_totalprice > 1000", "shipping", "FAIL", _NESTED),
    ),
)
def rule_nested_record_enclosing(spark, folder):
    rules = RuleFile.of(
        "orders",
        RecordOf(
            "shipping",
            [
                SingleTest("priority", "urgent", "{shipping.priority} LIKE '1-%' OR {shipping.priority} LIKE '2-%'", "WARN"),
                SingleTest("price", "price fits status", "{shipping.price} > 50000 OR {o_orderstatus} = 'F'"),
                Generic([SingleTest(None, "both", "{priority} IS NOT NULL AND {price} > 1000")]),
            ],
        ),
    )
    return flat(validate(orders_with_shipping(spark, folder), rules, nested_scope="enclosing"), "o_orderkey")


@query(
    "rule_union",
    union(
        test("events", "event_id", "amount", "value < 100", "payload", "WARN", "event_type = 'purchase'"),
        test("events", "event_id", "known type", "event_type IN ('click', 'view')", "payload", "FAIL",
             "event_type NOT IN ('purchase', 'error')"),
        test("events", "event_id", "nothing", "user_id > 100", "payload", "WARN", "event_type = 'error'"),
    ),
)
def rule_union(spark, folder):
    # purchases carry a number, errors nothing, everything else a text
    union_value = (
        "named_struct('member0', CASE WHEN event_type = 'purchase' THEN value END,"
        " 'member1', CASE WHEN event_type NOT IN ('purchase', 'error') THEN event_type END)"
    )
    events = table(spark, folder, "events").select("event_id", "user_id", F.expr(union_value).alias("payload"))
    rules = RuleFile.of(
        "events",
        UnionOf(
            "payload",
            {
                "member0": SingleTest("payload", "amount", "payload.member0 < 100", "WARN"),
                "member1": SingleTest("payload", "known type", "payload.member1 IN ('click', 'view')"),
                None: SingleTest("payload", "nothing", "user_id > 100", "WARN"),
            },
        ),
    )
    return flat(validate(events, rules), "event_id")


# The change type of a row, derived from the event type.
_CHANGE = """CASE event_type WHEN 'click' THEN 'I' WHEN 'view' THEN 'U' WHEN 'error' THEN 'D'
 WHEN 'signup' THEN 'X' ELSE NULL END"""


@query(
    "change_type_gate",
    f"""SELECT event_id, change_type,
  CASE WHEN change_type IN ('D', 'X', 'T') THEN NULL WHEN value > 50 THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CASE WHEN change_type IN ('D', 'X', 'T') OR value > 50 THEN value ELSE 50 END AS value
FROM (SELECT *, {_CHANGE} AS change_type FROM events)""",
)
def change_type_gate(spark, folder):
    events = table(spark, folder, "events").withColumn("__change_type", F.expr(_CHANGE))
    rules = RuleFile.of("events", SingleTest("value", "large", "value > 50", "FAIL", "50"))
    done = validate(events, rules).withColumn("change_type", F.col("__change_type"))
    return verdicts(done, "event_id", "change_type", "value")


@query(
    "null_condition_permissive",
    """SELECT o_orderkey,
  CASE WHEN p IS NULL THEN 'FAIL' WHEN p LIKE '1-%' THEN 'PASS' ELSE 'WARN' END AS verdict,
  CASE WHEN p IS NULL THEN 'priority is urgent' ELSE '' END AS no_result
FROM (SELECT *, nullif(o_orderpriority, '5-LOW') AS p FROM orders)""",
)
def null_condition_permissive(spark, folder):
    orders = table(spark, folder, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    rules = RuleFile.of("orders", SingleTest("o_orderpriority", "priority is urgent", "o_orderpriority LIKE '1-%'", "WARN"))
    done = validate(orders, rules, mode="permissive", error_column="errors")
    return verdicts(done.withColumn("no_result", F.array_join("errors", ",")), "o_orderkey", "no_result")


@query("rule_with_udf", test("customer", "c_custkey", "even digit sum",
                             "list_sum(list_transform(string_split(CAST(c_custkey AS VARCHAR), ''), lambda d: CAST(d AS INTEGER))) % 2 = 0",
                             "c_custkey", "WARN"))
def rule_with_udf(spark, folder):
    @F.pandas_udf("long")
    def digit_sum(keys: pd.Series) -> pd.Series:
        rest, total = keys.abs(), keys * 0
        while (rest > 0).any():
            total, rest = total + rest % 10, rest // 10
        return total

    spark.udf.register("digit_sum", digit_sum)
    rules = RuleFile.of("customer", SingleTest("c_custkey", "even digit sum", "digit_sum(c_custkey) % 2 = 0", "WARN"))
    return flat(validate(table(spark, folder, "customer"), rules), "c_custkey")


@query("rule_with_sql_function", test("orders", "o_orderkey", "fair price", "o_totalprice > CASE WHEN o_orderstatus = 'P' THEN 50000 ELSE 1000 END",
                                      "o_totalprice", "WARN"))
def rule_with_sql_function(spark, folder):
    define(spark, "fair_price", {"price": "DOUBLE", "status": "STRING"}, "BOOLEAN", "price > CASE WHEN status = 'P' THEN 50000 ELSE 1000 END")
    rules = RuleFile.of("orders", SingleTest("o_totalprice", "fair price", "fair_price(o_totalprice, o_orderstatus)", "WARN"))
    return flat(validate(table(spark, folder, "orders"), rules), "o_orderkey")
