"""The audit structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import ArrayOf, Generic, RuleFile, SingleTest, validate
from ruleloom.operators.reports import audit_rows
from ruleloom.sources.avro_schema import cleansed_name

from .arrays import _line
from .cleansing import lines_of_documents
from .registry import flat, query, table, test, union, verdicts
from .singles import ORDER_RULES, ORDER_RULES_SQL

_VERDICT = """CASE WHEN NOT (o_totalprice > 0) OR o_orderpriority = '4-NOT SPECIFIED' THEN 'FAIL'
  WHEN o_orderstatus NOT IN ('F', 'O') THEN 'WARN' ELSE 'PASS' END"""


@query("audit_details", ORDER_RULES_SQL)
def audit_details(spark, folder):
    return flat(validate(table(spark, folder, "orders"), ORDER_RULES), "o_orderkey")


@query(
    "audit_details_not_passed",
    f"SELECT * FROM ({ORDER_RULES_SQL}) WHERE result <> 'PASS'",
)
def audit_details_not_passed(spark, folder):
    return flat(validate(table(spark, folder, "orders"), ORDER_RULES, details="not_passed"), "o_orderkey")


@query("audit_verdict", f"SELECT o_orderkey, {_VERDICT} AS verdict FROM orders")
def audit_verdict(spark, folder):
    return verdicts(validate(table(spark, folder, "orders"), ORDER_RULES, details="none"), "o_orderkey")


@query(
    "audit_quality",
    f"""SELECT o_orderkey, CAST(min(quality) AS INTEGER) AS lowest, CAST(sum(quality) AS INTEGER) AS total
FROM ({ORDER_RULES_SQL}) GROUP BY o_orderkey""",
)
def audit_quality(spark, folder):
    scores = "transform(__audit.__details, d -> CAST(d.__transformresult_quality AS INT))"
    done = validate(table(spark, folder, "orders"), ORDER_RULES)
    return done.select(
        "o_orderkey",
        F.expr(f"array_min({scores})").alias("lowest"),
        F.expr(f"aggregate({scores}, 0, (a, b) -> a + b)").alias("total"),
    )


@query("audit_paths", "SELECT doc_id, text, result FROM (" + union(
    _line("not too long", "length(line) <= 300", "line", "WARN"),
    _line("ends well", "length(line) = 0 OR line LIKE '%.'", None, "WARN"),
    test("documents", "doc_id", "language", "lang = 'en'", "lang", "WARN"),
    test("documents", "doc_id", "any", "lang <> source", None),
) + ")")
def audit_paths(spark, folder):
    rules = RuleFile.of(
        "documents",
        ArrayOf("lines", [
            SingleTest("line", "not too long", "{size} <= 300", "WARN"),
            SingleTest(None, "ends well", "{size} = 0 OR {line} LIKE '%.'", "WARN"),
        ]),
        SingleTest("lang", "language", "lang = 'en'", "WARN"),
        Generic([SingleTest(None, "any", "lang <> source")]),
    )
    return flat(validate(lines_of_documents(spark, folder), rules), "doc_id").select("doc_id", "text", "result")


_EXISTING = """named_struct('__transformresult', CASE WHEN o_orderkey % 3 = 0 THEN 'WARN' ELSE 'PASS' END,
 '__details', CASE WHEN o_orderkey % 3 < 2 THEN array(named_struct('__transformationname', 'earlier',
 '__transformresult', CASE WHEN o_orderkey % 3 = 0 THEN 'WARN' ELSE 'PASS' END,
 '__transformresult_text', 'upstream', '__transformresult_quality', CAST(NULL AS TINYINT))) END)"""


@query(
    "audit_merge_existing",
    f"""SELECT d.o_orderkey, d.n, d.rule, d.result, v.verdict FROM (
  SELECT o_orderkey, CAST(1 AS INTEGER) AS n, 'earlier' AS rule,
         CASE WHEN o_orderkey % 3 = 0 THEN 'WARN' ELSE 'PASS' END AS result FROM orders WHERE o_orderkey % 3 < 2
  UNION ALL
  SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 < 2 THEN 2 ELSE 1 END AS INTEGER), 'large order',
         CASE WHEN o_totalprice > 100000 THEN 'PASS' ELSE 'FAIL' END FROM orders) d
JOIN (SELECT o_orderkey, CASE WHEN NOT (o_totalprice > 100000) THEN 'FAIL' WHEN o_orderkey % 3 = 0 THEN 'WARN'
      ELSE 'PASS' END AS verdict FROM orders) v ON d.o_orderkey = v.o_orderkey""",
)
def audit_merge_existing(spark, folder):
    orders = table(spark, folder, "orders")
    orders = orders.withColumn("__audit", F.when(F.col("o_orderkey") % 3 < 2, F.expr(_EXISTING)))
    done = validate(orders, RuleFile.of("orders", SingleTest("o_totalprice", "large order", "o_totalprice > 100000")))
    rows = audit_rows(done.withColumn("verdict", F.col("__audit.__transformresult")), ["o_orderkey", "verdict"], "n")
    return rows.select("o_orderkey", "n", "rule", "result", "verdict")


@query(
    "audit_schema_added",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 'PASS' AS audit_result,"
    " CAST(1 AS INTEGER) AS audit_details, 'customer_CLEANSED' AS schema_name FROM customer",
)
def audit_schema_added(spark, folder):
    customer = table(spark, folder, "customer")
    done = validate(customer, RuleFile.of("customer", SingleTest("c_custkey", "key given", "c_custkey IS NOT NULL")))
    return done.select(
        *customer.columns,
        F.col("__audit.__transformresult").alias("audit_result"),
        F.size("__audit.__details").alias("audit_details"),
        F.lit(cleansed_name("customer")).alias("schema_name"),
    )


