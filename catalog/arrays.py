"""Rules on array elements, access to outer records, lookups in arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import ArrayOf, Generic, RuleFile, SingleTest, TestSet, validate
from ruleloom.functions import formulas as fx

from .cleansing import lines_of_documents
from .registry import detail, flat, query, table, test, union

_LINES = """(SELECT doc_id, lang, source, line, n FROM (SELECT doc_id, lang, source,
  unnest(string_split(text, chr(10))) AS line,
  unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents))"""


def _line(rule, condition, field, if_false="FAIL", where="true"):
    suffix = f".{field}" if field else ""
    text = f"'lines[' || n || ']{suffix}'"
    return detail(_LINES, "doc_id", rule, f"CASE WHEN {condition} THEN 'PASS' ELSE '{if_false}' END", text, where)


@query(
    "rule_array_records",
    union(
        _line("not too long", "length(line) <= 300", "line", "WARN"),
        _line("short", "length(line) < 20", "size", "FAIL"),
        _line("has blank", "contains(line, ' ')", "size", "FAIL", "length(line) >= 20"),
        _line("ends well", "length(line) = 0 OR line LIKE '%.'", None, "WARN"),
    ),
)
def rule_array_records(spark, folder):
    rules = RuleFile.of(
        "documents",
        ArrayOf(
            "lines",
            [
                SingleTest("line", "not too long", "e.size <= 300", "WARN"),
                TestSet(
                    "size", "short or words", "until_passes",
                    [
                        SingleTest("size", "short", "{size} < 20"),
                        SingleTest("size", "has blank", "contains({line}, ' ')"),
                    ],
                ),
                Generic([SingleTest(None, "ends well", "{size} = 0 OR {line} LIKE '%.'", "WARN")]),
            ],
        ),
    )
    return flat(validate(lines_of_documents(spark, folder), rules), "doc_id")


@query(
    "rule_array_primitives",
    detail(
        "(SELECT vec_id, label, unnest(embedding) AS e FROM embeddings)",
        "vec_id", "in range", "CASE WHEN e BETWEEN -0.3 AND 0.3 OR label = 0 THEN 'PASS' ELSE 'WARN' END", "'embedding'",
    ),
)
def rule_array_primitives(spark, folder):
    rules = RuleFile.of(
        "embeddings",
        ArrayOf("embedding", [SingleTest("embedding", "in range", "CAST(e AS DOUBLE) BETWEEN -0.3 AND 0.3 OR label = 0", "WARN")]),
    )
    return flat(validate(table(spark, folder, "embeddings"), rules), "vec_id")


@query(
    "rule_parent_access",
    union(
        _line("english is ascii", "lang <> 'en' OR NOT regexp_matches(line, '[^ -~]')", "line", "WARN"),
        _line("source and line differ", "source <> line", "line", "FAIL"),
    ),
)
def rule_parent_access(spark, folder):
    rules = RuleFile.of(
        "documents",
        ArrayOf(
            "lines",
            [
                SingleTest("line", "english is ascii", "{parent.parent.lang} <> 'en' OR NOT ({line} RLIKE '[^ -~]')", "WARN"),
                SingleTest("line", "source and line differ", "source <> e.line"),
            ],
        ),
    )
    return flat(validate(lines_of_documents(spark, folder), rules), "doc_id")


def _charges(spark, folder):
    charges = (
        "array(named_struct('kind', 'tax', 'rate', l_tax), named_struct('kind', 'discount', 'rate', l_discount),"
        " named_struct('kind', 'flag', 'rate', CASE l_returnflag WHEN 'R' THEN 1.0D ELSE 0.0D END))"
    )
    listed = F.expr(f"CASE WHEN l_quantity > 10 THEN {charges} END").alias("charges")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", listed)


_WANTED = "CASE WHEN l_linenumber = 1 THEN 'discount' ELSE 'fee' END"
_FOUND = "(SELECT *, CASE WHEN l_quantity > 10 THEN l_discount END AS d FROM lineitem)"


@query(
    "array_find",
    union(
        test(_FOUND, "l_orderkey, l_linenumber", "has discount", "d IS NOT NULL", "charges"),
        test(_FOUND, "l_orderkey, l_linenumber", "low discount", "coalesce(d, 0) < 0.05", "charges", "WARN"),
        test(_FOUND, "l_orderkey, l_linenumber", "no fee", "NOT (l_linenumber = 1 AND l_quantity > 10)", "charges"),
    ),
)
def array_find(spark, folder):
    discount = fx.find("charges", "kind", "'discount'")
    rules = RuleFile.of(
        "lineitem",
        SingleTest("charges", "has discount", f"{discount} IS NOT NULL"),
        SingleTest("charges", "low discount", f"coalesce({discount}.rate, 0) < 0.05", "WARN"),
        SingleTest("charges", "no fee", f"{fx.find('charges', 'kind', _WANTED)} IS NULL"),
    )
    return flat(validate(_charges(spark, folder), rules), "l_orderkey", "l_linenumber")


@query(
    "safe_navigation",
    union(
        test("lineitem", "l_orderkey, l_linenumber", "first is tax", "l_quantity > 10", "charges"),
        test("lineitem", "l_orderkey, l_linenumber", "none there", "l_quantity <= 10 OR l_linenumber > 3", "charges"),
        test("lineitem", "l_orderkey, l_linenumber", "guarded", "l_quantity <= 10 OR l_tax < 0.05", "charges", "WARN"),
    ),
)
def safe_navigation(spark, folder):
    rules = RuleFile.of(
        "lineitem",
        SingleTest("charges", "first is tax", f"{fx.item('charges', '0')}.kind <=> 'tax'"),
        SingleTest("charges", "none there", f"{fx.item('charges', 'l_linenumber - 1')}.kind IS NULL"),
        SingleTest("charges", "guarded", "CASE WHEN charges IS NULL THEN true ELSE charges[0].rate < 0.05 END", "WARN"),
    )
    return flat(validate(_charges(spark, folder), rules), "l_orderkey", "l_linenumber")




@query(
    "rule_array_in_array",
    """SELECT conv_id, turn, result, CAST(count(*) AS BIGINT) AS tests FROM (
  SELECT conv_id, turn, CASE WHEN length(word) <= 8 OR role = 'user' THEN 'PASS' ELSE 'WARN' END AS result FROM (
    SELECT conv_id, turn, role, unnest(string_split(line, ' ')) AS word FROM (
      SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line FROM conversations)))
GROUP BY conv_id, turn, result""",
)
def rule_array_in_array(spark, folder):
    nested = "transform(split(text, '\\n'), l -> named_struct('words', transform(split(l, ' '), w -> named_struct('word', w))))"
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.expr(nested).alias("lines"))
    short = SingleTest("word", "short word", "length({word}) <= 8 OR {parent.parent.parent.parent.role} = 'user'", "WARN")
    rules = RuleFile.of("conversations", ArrayOf("lines", [ArrayOf("words", [short])]))
    # the details of one record stay inside it, so they are counted without a shuffle
    rows = validate(turns, rules).select(
        "conv_id", "turn",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(r).alias("result"),
                        F.expr(f"CAST(size(filter(__audit.__details, d -> d.__transformresult = '{r}')) AS LONG)").alias("tests"),
                    )
                    for r in ("PASS", "WARN")
                ]
            )
        ).alias("c"),
    )
    # several rows may share conversation and turn
    return (
        rows.where("c.tests > 0").groupBy("conv_id", "turn", F.col("c.result").alias("result")).agg(F.sum("c.tests").alias("tests"))
    )
