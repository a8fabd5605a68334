"""The formula helpers, value by value."""

import time

import pytest

from ruleloom.functions import formulas as fx

CASES = [
    (fx.same("NULL", "NULL"), True),
    (fx.same("1", "NULL"), False),
    (fx.differs("1", "NULL"), True),
    (fx.conditional("1 > 2", "'a'", "'b'"), "b"),
    (fx.first_given("NULL", "3"), 3),
    (fx.empty("''"), True),
    (fx.empty("' '"), False),
    (fx.empty("CAST(NULL AS STRING)"), True),
    (fx.empty_collection("array()"), True),
    (fx.empty_collection("array(1)"), False),
    (fx.blank("' \\t '"), True),
    (fx.blank("' x '"), False),
    (fx.matches("'12345'", r"\d{5}"), True),
    (fx.matches("'12345x'", r"\d{5}"), False),
    (fx.matches("'b'", "a|b"), True),
    (fx.matches("'xb'", "a|b"), False),
    (fx.member("2", "array(1, 2)"), True),
    (fx.matches("'abc\\n'", "abc"), False),
    (fx.find("array(named_struct('a b', 1, 'n', 5), named_struct('a b', 2, 'n', 6))", "a b", "2") + ".n", 6),
    (fx.index_of("'hello'", "'l'"), 2),
    (fx.index_of("'hello'", "'z'"), -1),
    (fx.char_at("'hello'", "1"), "e"),
    (fx.substring("'hello'", "1", "3"), "el"),
    (fx.substring("'hello'", "2"), "llo"),
    (fx.equals_ignore_case("'AbC'", "'aBc'"), True),
    (fx.item("array(1)", "3"), None),
    (fx.item("array(1)", "0"), 1),
    (fx.find("array(named_struct('k', 1, 'v', 'a'), named_struct('k', 2, 'v', 'b'))", "k", "2") + ".v", "b"),
    (fx.find("array(named_struct('k', 1, 'v', 'a'))", "k", "5"), None),
    (fx.json_value("'{\"k\": 5}'", "$.k", "INT"), 5),
    (fx.json_value("'{\"k\": \"x\"}'", "$.k", "INT"), None),
    (fx.json_value("'broken'", "$.k"), None),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_formula(spark, text, expected):
    assert spark.range(1).selectExpr(f"{text} AS v").first()["v"] == expected


def test_find_does_not_hide_columns(spark):
    df = spark.createDataFrame([(2, [(1, "x"), (2, "y")])], "f int, l array<struct<k: int, t: string>>")
    assert df.selectExpr(fx.find("l", "k", "f") + ".t").first()[0] == "y"


@pytest.mark.parametrize("text, pattern, parts", [
    ("a,b,,c,,", ",", ["a", "b", "", "c"]), (",a", ",", ["", "a"]), (",,", ",", []), ("", ",", [""]), ("abc", ",", ["abc"]), (None, ",", None),
    ("a1b22c", "[0-9]+", ["a", "b", "c"]), ("__text", "_", ["", "", "text"]),
])
def test_split(spark, text, pattern, parts):
    df = spark.createDataFrame([(text,)], "__text string")
    assert df.selectExpr(fx.split("__text", pattern) + " AS v").first()["v"] == parts


def test_split_grows_with_the_text(spark):
    def seconds(words):
        df = spark.range(400).selectExpr(f"array_join(transform(sequence(1, {words}), n -> concat('w', n)), ' ') AS t").cache()
        df.count()
        found = []
        for _ in range(3):
            start = time.perf_counter()
            df.selectExpr(f"sum(size({fx.split('t', ' ')}))").collect()
            found.append(time.perf_counter() - start)
        df.unpersist()
        return min(found)

    seconds(500)
    assert seconds(4000) < 30 * max(0.05, seconds(500))


def test_arguments_are_not_repeated_in_loops(spark):
    plan = spark.sql("SELECT 'a b' AS t, array(named_struct('k', 1)) AS l").selectExpr(
        fx.split("upper(t)", " ") + " AS s", fx.find("l", "k", "length(lower(t))") + " AS f"
    )._jdf.queryExecution().analyzed().toString()
    assert plan.count("upper(") == 1 and plan.count("lower(") == 1
