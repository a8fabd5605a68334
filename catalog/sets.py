"""Test sets: all, until failed, until passes, nested, and their roll-up."""

from __future__ import annotations

from ruleloom import Generic, RuleFile, SingleTest, TestSet, validate

from .registry import flat, query, table, test, union, verdicts

KEYS = "l_orderkey, l_linenumber"

_A = "l_quantity <= 40"
_B = "l_extendedprice < 60000"
_C = "l_returnflag <> 'R'"


@query(
    "testset_all",
    union(
        test("lineitem", KEYS, "quantity", _A, "l_quantity", "WARN"),
        test("lineitem", KEYS, "price", _B, "l_quantity"),
        test("lineitem", KEYS, "not returned", _C, "l_quantity"),
    ),
)
def testset_all(spark, folder):
    rules = RuleFile.of(
        "lineitem",
        TestSet(
            "l_quantity", "line", "all",
            [
                SingleTest("l_quantity", "quantity", _A, "WARN"),
                SingleTest("l_quantity", "price", _B),
                SingleTest("l_quantity", "not returned", _C),
            ],
        ),
    )
    return flat(validate(table(spark, folder, "lineitem"), rules), "l_orderkey", "l_linenumber")


@query(
    "testset_first_fail",
    union(
        test("lineitem", KEYS, "price", _B, "l_extendedprice"),
        test("lineitem", KEYS, "quantity", _A, "l_extendedprice", "WARN", _B),
        test("lineitem", KEYS, "not returned", _C, "l_extendedprice", "FAIL", _B),
        test("lineitem", KEYS, "open", "l_linestatus = 'O'", "l_extendedprice", "FAIL", f"({_B}) AND ({_C})"),
    ),
)
def testset_first_fail(spark, folder):
    rules = RuleFile.of(
        "lineitem",
        TestSet(
            "l_extendedprice", "line", "until_failed",
            [
                SingleTest("l_extendedprice", "price", _B),
                SingleTest("l_extendedprice", "quantity", _A, "WARN"),
                SingleTest("l_extendedprice", "not returned", _C),
                SingleTest("l_extendedprice", "open", "l_linestatus = 'O'"),
            ],
        ),
    )
    return flat(validate(table(spark, folder, "lineitem"), rules), "l_orderkey", "l_linenumber")


@query(
    "testset_first_pass",
    union(
        test("lineitem", KEYS, "accepted", "l_returnflag = 'A'", "l_returnflag"),
        test("lineitem", KEYS, "new", "l_returnflag = 'N'", "l_returnflag", "FAIL", "l_returnflag <> 'A'"),
        test("lineitem", KEYS, "returned", "l_returnflag = 'R' AND l_quantity < 30", "l_returnflag", "WARN",
             "l_returnflag NOT IN ('A', 'N')"),
        test("lineitem", KEYS, "cheap", "l_extendedprice < 50000", "l_returnflag", "FAIL",
             "l_returnflag NOT IN ('A', 'N') AND NOT (l_returnflag = 'R' AND l_quantity < 30)"),
    ),
)
def testset_first_pass(spark, folder):
    return flat(validate(table(spark, folder, "lineitem"), RuleFile.of("lineitem", _flags())), "l_orderkey", "l_linenumber")


def _flags():
    return TestSet(
        "l_returnflag", "known flag", "until_passes",
        [
            SingleTest("l_returnflag", "accepted", "l_returnflag = 'A'"),
            SingleTest("l_returnflag", "new", "l_returnflag = 'N'"),
            SingleTest("l_returnflag", "returned", "l_returnflag = 'R' AND l_quantity < 30", "WARN"),
            SingleTest("l_returnflag", "cheap", "l_extendedprice < 50000"),
        ],
    )


@query(
    "testset_nested",
    union(
        test("lineitem", KEYS, "has price", "l_extendedprice > 5000", None),
        test("lineitem", KEYS, "accepted", "l_returnflag = 'A'", None, "FAIL", "l_extendedprice > 5000"),
        test("lineitem", KEYS, "small", "l_quantity < 20", None, "FAIL", "l_extendedprice > 5000 AND l_returnflag <> 'A'"),
        test("lineitem", KEYS, "taxed", "l_tax > 0.01", None, "WARN",
             "l_extendedprice > 5000 AND (l_returnflag = 'A' OR l_quantity < 20)"),
        test("lineitem", KEYS, "discounted", "l_discount > 0.01", None, "FAIL",
             "l_extendedprice > 5000 AND (l_returnflag = 'A' OR l_quantity < 20)"),
    ),
)
def testset_nested(spark, folder):
    return flat(validate(table(spark, folder, "lineitem"), RuleFile.of("lineitem", _nested())), "l_orderkey", "l_linenumber")


def _nested():
    return Generic(
        [
            TestSet(
                None, "outer", "until_failed",
                [
                    SingleTest(None, "has price", "l_extendedprice > 5000"),
                    TestSet(
                        None, "either", "until_passes",
                        [
                            SingleTest(None, "accepted", "l_returnflag = 'A'"),
                            SingleTest(None, "small", "l_quantity < 20"),
                        ],
                    ),
                    TestSet(
                        None, "both", "all",
                        [
                            SingleTest(None, "taxed", "l_tax > 0.01", "WARN"),
                            SingleTest(None, "discounted", "l_discount > 0.01"),
                        ],
                    ),
                ],
            )
        ]
    )


@query(
    "verdict_by_sets",
    """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag IN ('A', 'N') OR (l_returnflag = 'R' AND l_quantity < 30) OR l_extendedprice < 50000
       THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM lineitem""",
)
def verdict_by_sets(spark, folder):
    done = validate(table(spark, folder, "lineitem"), RuleFile.of("lineitem", _flags()), verdict="sets", details="none")
    return verdicts(done, "l_orderkey", "l_linenumber")


@query(
    "audit_qualified_names",
    union(
        test("lineitem", KEYS, "outer/has price", "l_extendedprice > 5000", None),
        test("lineitem", KEYS, "outer/either/accepted", "l_returnflag = 'A'", None, "FAIL", "l_extendedprice > 5000"),
        test("lineitem", KEYS, "outer/either/small", "l_quantity < 20", None, "FAIL",
             "l_extendedprice > 5000 AND l_returnflag <> 'A'"),
        test("lineitem", KEYS, "outer/both/taxed", "l_tax > 0.01", None, "WARN",
             "l_extendedprice > 5000 AND (l_returnflag = 'A' OR l_quantity < 20)"),
        test("lineitem", KEYS, "outer/both/discounted", "l_discount > 0.01", None, "FAIL",
             "l_extendedprice > 5000 AND (l_returnflag = 'A' OR l_quantity < 20)"),
    ),
)
def audit_qualified_names(spark, folder):
    done = validate(table(spark, folder, "lineitem"), RuleFile.of("lineitem", _nested()), qualify_names=True)
    return flat(done, "l_orderkey", "l_linenumber")
