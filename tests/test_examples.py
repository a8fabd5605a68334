"""Worked examples: sets that stop, arrays whose elements look around, steps, rule files, Avro schema text."""

import json

import pytest
from audit_helpers import details, verdict
from pyspark.sql import functions as F

from ruleloom import ArrayOf, Generic, RecordOf, RuleFile, SingleTest, Step, TestSet, UnionOf, validate
from ruleloom.operators.dryrun import sample_record, trace
from ruleloom.plans.audit import AUDIT_TYPE
from ruleloom.sources.avro_schema import audited_schema, cleansed_name, schema_name, struct_type
from ruleloom.sources.rulefiles import TopicRule, load_rule_file, parse_rule_file, sample_values

# A meter sends readings of a night; the checks build on each other, so a reading that is out of order is not judged further.
METER_RULES = TestSet(
    "kwh", "night reading", "until_failed",
    [
        SingleTest("kwh", "counts up", "kwh >= kwh_before"),
        SingleTest("kwh", "usual use", "kwh - kwh_before <= 20", "WARN"),
        TestSet("hours", "duration", "all", [
            SingleTest("hours", "whole hours", "hours = floor(hours)", "PASS", "floor(hours)"), SingleTest("hours", "a night", "hours BETWEEN 4 AND 16"),
        ]),
        SingleTest("kwh", "power below the fuse", "(kwh - kwh_before) / hours < 3.7"),
    ],
)


@pytest.mark.parametrize("before, kwh, hours, codes, set_verdict", [
    (100.0, 108.0, 8.0, "counts up=PASS usual use=PASS whole hours=PASS a night=PASS power below the fuse=PASS", "PASS"),
    (100.0, 99.9, 8.0, "counts up=FAIL", "FAIL"),
    (100.0, 124.0, 8.0, "counts up=PASS usual use=WARN whole hours=PASS a night=PASS power below the fuse=PASS", "WARN"),
    (100.0, 119.0, 4.5, "counts up=PASS usual use=PASS whole hours=PASS a night=PASS power below the fuse=FAIL", "FAIL"),
    (100.0, 101.0, 2.0, "counts up=PASS usual use=PASS whole hours=PASS a night=FAIL", "FAIL"),
])
def test_a_set_stops_at_its_first_failure(spark, before, kwh, hours, codes, set_verdict):
    df = spark.createDataFrame([(before, kwh, hours)], "kwh_before double, kwh double, hours double")
    for by in ("details", "sets"):
        out = validate(df, RuleFile.of("meter", METER_RULES), verdict=by).first()
        assert " ".join(f"{d[0]}={d[1]}" for d in details(out)) == codes
        assert verdict(out) == set_verdict
        assert out["hours"] == (int(hours) if "whole hours" in codes else hours)


@pytest.fixture(scope="module")
def tracks(spark):
    """Points of recorded tracks and the strip of land they are meant to stay in."""
    return spark.createDataFrame(
        [
            ("loop", 0, 10, [(1, 5), (4, 6), (9, 5), (1, 5)]),
            ("stray", 0, 10, [(2, 1), (14, 2), (-3, 2)]),
            ("gap", 0, 10, [(2, 1), None, (3, 1)]),
            ("none", 0, 10, None),
            ("still", 3, 3, []),
        ],
        "name string, west int, east int, points array<struct<x: int, y: int>>",
    )


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_elements_see_their_neighbours_and_the_record(tracks):
    near = SingleTest("x", "no leap", "i = 0 OR abs({x} - get(points, i - 1).x) <= 5", "WARN")
    inside = SingleTest("x", "on the strip", "{x} BETWEEN west AND {parent.parent.east}", "PASS", "greatest(west, least(east, {x}))")
    closed = Generic([SingleTest(None, "closed", "size(points) = 0 OR element_at(points, -1) <=> get(points, 0)", "WARN")])
    some = tracks.where("name IN ('loop', 'stray', 'still')")
    out = by_name(validate(some, RuleFile.of("track", ArrayOf("points", [inside, near]), closed)))
    assert [(d[0], d[1], d[2]) for d in details(out["loop"])] == [
        (rule, "PASS", f"points[{n}].x") for n in range(4) for rule in ("on the strip", "no leap")
        if (n, rule) != (3, "no leap")
    ] + [("no leap", "WARN", "points[3].x"), ("closed", "PASS", None)]
    assert [p["x"] for p in out["stray"]["points"]] == [2, 10, 0]
    assert [d[1] for d in details(out["stray"]) if d[0] == "no leap"] == ["PASS", "WARN", "WARN"]  # by the points as they came
    assert verdict(out["still"]) == "PASS" and details(out["still"]) == [("closed", "PASS", None, 100)]


def test_missing_elements_and_arrays_have_no_tests(tracks):
    out = by_name(validate(tracks, RuleFile.of("track", ArrayOf("points", [SingleTest("y", "low", "{y} < 2", "FAIL", "0")]))))
    assert details(out["gap"]) == [("low", "PASS", "points[0].y", 100), ("low", "PASS", "points[2].y", 100)]
    assert out["gap"]["points"][1] is None and out["none"]["points"] is None
    assert details(out["none"]) == [] and verdict(out["none"]) == "PASS"
    assert [p["y"] for p in out["loop"]["points"]] == [0, 0, 0, 0] and verdict(out["loop"]) == "FAIL"


def test_alternatives_are_tried_in_turn(spark):
    df = spark.createDataFrame([(n, *row) for n, row in enumerate([(50, 50, None), (51, 50, None), (70, 50, "Kim"), (70, 50, None)])],
                               "id int, counted int, booked int, signed string")
    rules = RuleFile.of("stock", TestSet("counted", "accepted", "until_passes", [
        SingleTest("counted", "equal", "counted = booked"), SingleTest("counted", "within two", "abs(counted - booked) <= 2"),
        SingleTest("counted", "signed off", "signed IS NOT NULL", "WARN"),
    ]))
    by_details, by_sets = ([verdict(r) for r in validate(df, rules, verdict=v).orderBy("id").collect()] for v in ("details", "sets"))
    assert by_details == ["PASS", "FAIL", "FAIL", "FAIL"] and by_sets == ["PASS", "PASS", "PASS", "WARN"]
    assert [len(details(r)) for r in validate(df, rules).orderBy("id").collect()] == [1, 2, 3, 3]


def test_skeleton_file_has_no_tests(spark):
    empty = '{"type": "EmptyRule", "fieldname": "%s", "rules": null}'
    more = '{"type": "GenericRules", "fieldname": "(more)", "rules": null}'  # the file format's name for further fields
    inner = ", ".join(empty % f for f in ("degrees", "minutes"))
    text = f'''{{"rulesteps": [{{"type": "RuleStep", "fieldname": "bake", "rules": [{empty % "batch"},
      {{"type": "RecordRule", "fieldname": "oven", "rules": [{inner}, {more}]}}, {more}]}}]}}'''
    df = spark.createDataFrame([(7, (220, 35.5))], "batch int, oven struct<degrees: int, minutes: double>")
    out = validate(df, parse_rule_file(text)).first()
    assert verdict(out) == "PASS" and details(out) == []


def test_file_without_steps_changes_nothing(spark):
    df = spark.range(1)
    assert validate(df, parse_rule_file('{"name": "x"}')).columns == ["id"]


def test_rule_types_of_files(spark, tmp_path):
    text = """{"rulesteps": [{"type": "RuleStep", "fieldname": "s", "rules": [
      {"type": "TestSetAll", "fieldname": "a", "rulename": "all", "rules": [
        {"type": "TestSetFirstFail", "fieldname": "a", "rulename": "ff", "rules": [
          {"type": "PrimitiveRule", "fieldname": "a", "rulename": "r", "condition": "a > 0", "iffalse": "WARN", "substitute": ""}]},
        {"type": "TestSetFirstPass", "fieldname": "a", "rulename": "fp", "rules": []}, {"type": "EmptyRule"}]},
      {"type": "ArrayRule", "fieldname": "l", "rules": [{"type": "RecordRule", "fieldname": "l", "rules": [
        {"type": "PrimitiveRule", "fieldname": "x", "rulename": "rx", "condition": "e.x > 0"}]}]},
      {"type": "UnionRule", "fieldname": "u", "rules": [
        {"type": "EmptyRule", "fieldname": "u", "fielddatatype": "NULL"},
        {"type": "PrimitiveRule", "fieldname": "u", "rulename": "r0", "condition": "u.member0 > 0"},
        {"type": "PrimitiveRule", "fieldname": "u", "rulename": "r1", "condition": "u.member1 <> ''"}]}]}]}"""
    folder = tmp_path / "SUBJECT" / "active" / "sub"
    folder.mkdir(parents=True)
    (folder / "file.json").write_text(text)
    assert load_rule_file(tmp_path, "SUBJECT", "none.json") is None
    with pytest.raises(ValueError):
        load_rule_file(tmp_path, "SUBJECT", "/file.json")
    job = TopicRule.parse('{"inputtopicname": "in", "outputtopicname": "out", "rulefiles": ["SUBJECT/sub/file.json"]}')
    (rules,) = job.load(tmp_path)
    assert rules.input_subject == "SUBJECT" and rules.name == "sub/file.json"
    (step,) = rules.steps
    outer, listed, union = step.rules
    assert [s.mode for s in outer.rules] == ["until_failed", "until_passes"]
    assert outer.rules[0].rules[0].substitute is None
    assert listed == ArrayOf("l", [RecordOf(None, [SingleTest("x", "rx", "e.x > 0")])])
    assert [m for m, _ in union.branches] == ["member0", "member1"]
    df = spark.createDataFrame(
        [(1, [(1,), (-1,)], (None, "x"))], "a int, l array<struct<x: int>>, u struct<member0: int, member1: string>"
    )
    out = validate(df, rules).first()
    assert details(out) == [("r", "PASS", "a", 100), ("rx", "PASS", "l[0].x", 100), ("rx", "FAIL", "l[1].x", 0), ("r1", "PASS", "u", 100)]


def test_topic_rule_is_checked():
    with pytest.raises(ValueError):
        TopicRule("same", "same")
    with pytest.raises(ValueError):
        TopicRule("in", "out", ["nofolder.json"]).load("/nowhere")
    assert TopicRule("orders", "clean").consumer_group == "rules_orders"


def test_unknown_rule_type():
    with pytest.raises(ValueError, match="unknown rule type"):
        parse_rule_file('{"rulesteps": [{"fieldname": "s", "rules": [{"type": "Other"}]}]}')


AVRO = """{"type": "record", "name": "PARCEL", "namespace": "post", "fields": [
 {"name": "__change_type", "type": {"type": "string", "logicalType": "VARCHAR", "length": 1}},
 {"name": "__change_time", "type": {"type": "long", "logicalType": "timestamp-millis"}},
 {"name": "__extension", "type": ["null", {"type": "array", "items": {"type": "record", "name": "__extension", "fields": [
   {"name": "__path", "type": {"type": "string", "logicalType": "STRING"}},
   {"name": "__value", "type": ["null", {"type": "boolean"}, {"type": "int"}, "string"]}]}}]},
 {"name": "quality", "type": ["null", {"type": "int", "logicalType": "BYTE"}]},
 {"name": "kind", "type": {"type": "enum", "name": "KIND", "symbols": ["A", "B"]}},
 {"name": "other", "type": ["null", "KIND"]},
 {"name": "tags", "type": {"type": "map", "values": "double"}},
 {"name": "price", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}},
 {"name": "hash", "type": {"type": "fixed", "name": "MD5", "size": 16}}]}"""


def test_avro_schema_text():
    assert struct_type(AVRO).simpleString() == (
        "struct<__change_type:string,__change_time:timestamp,__extension:array<struct<__path:string,"
        "__value:struct<member0:boolean,member1:int,member2:string>>>,quality:tinyint,kind:string,other:string,"
        "tags:map<string,double>,price:decimal(9,2),hash:binary>"
    )
    assert [f.nullable for f in struct_type(AVRO).fields] == [False, False, True, True, False, True, False, False, False]
    assert schema_name(AVRO) == "post.PARCEL" and cleansed_name("PARCEL") == "PARCEL_CLEANSED"


def test_avro_names_and_namespaces():
    text = """{"type": "record", "name": "a.Outer", "fields": [
      {"name": "k", "type": {"type": "enum", "name": "K", "symbols": ["X"]}}, {"name": "same", "type": "a.K"}, {"name": "short", "type": ["null", "K"]},
      {"name": "in", "type": {"type": "record", "name": "Inner", "namespace": "b", "fields": [
        {"name": "far", "type": "a.K"}, {"name": "own", "type": {"type": "fixed", "name": "F", "size": 2}}, {"name": "again", "type": "F"}]}},
      {"name": "last", "type": "b.F"}]}"""
    assert struct_type(text).simpleString() == (
        "struct<k:string,same:string,short:string,in:struct<far:string,own:binary,again:binary>,last:binary>"
    )
    with pytest.raises(ValueError, match="contains itself"):
        struct_type('{"type": "record", "name": "R", "fields": [{"name": "next", "type": ["null", "R"]}]}')
    with pytest.raises(ValueError, match="unknown"):
        struct_type('{"type": "record", "name": "a.R", "fields": [{"name": "x", "type": "b.K"}]}')


def test_schema_of_validated_records():
    text = '{"type": "record", "name": "R", "namespace": "x", "fields": [{"name": "v", "type": "int"}]}'
    out = audited_schema(text)
    assert schema_name(out) == "x.R_CLEANSED" and schema_name(text) == "x.R"
    assert struct_type(out)["__audit"].dataType.simpleString() == AUDIT_TYPE.simpleString() and struct_type(out)["__audit"].nullable
    assert len(json.loads(audited_schema(out))["fields"]) == 2


def test_permissive_mode_goes_on_after_runtime_errors(spark):
    df = spark.createDataFrame([(0, "a"), (2, "b"), (None, "c")], "v int, t string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    for formula in ("10 / v > 1", "CAST(t AS INT) > 0 OR v = 2", "array(1)[v] > 0 OR v = 2"):
        out = validate(df, RuleFile.of("x", SingleTest("v", "r", formula)), mode="permissive", error_column="e").collect()
        assert [r["e"] for r in out] == [["r"] if formula[0] != "a" else [], [], ["r"]], formula
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_permissive_substitutes_keep_the_value(spark):
    df = spark.createDataFrame([(5, "x")], "v int, t string")
    rules = RuleFile.of("x", SingleTest("v", "r", "v > 9", "WARN", "concat('n', t)"))
    out = validate(df, rules, mode="permissive", error_column="e").first()
    assert (out["v"], out["e"], verdict(out)) == (5, ["r"], "FAIL")
    row = trace(df, rules, ["t"]).first()
    assert (row["input"], row["output"], row["result"]) == ("5", "5", "FAIL") and "old one stays" in row["error"]
    blank = RuleFile.of("x", SingleTest("v", "r", "v > 9", "WARN", "nullif(v, 5)"))
    out = validate(df, blank, mode="permissive", error_column="e").first()
    assert (out["v"], out["e"], verdict(out)) == (None, [], "WARN")
    with pytest.raises(ValueError, match="already"):
        validate(df, rules, mode="permissive", error_column="v")


def test_change_types_and_existing_audit(spark):
    kinds = ["I", "U", "A", "D", "X", "T", None]
    df = spark.createDataFrame([(k, -1) for k in kinds], "__change_type string, v int")
    out = validate(df, RuleFile.of("t", SingleTest("v", "positive", "v > 0", "WARN", "0"))).collect()
    for row in out:
        if row["__change_type"] in ("D", "X", "T"):
            assert row["__audit"] is None and row["v"] == -1
        else:
            assert verdict(row) == "WARN" and row["v"] == 0


@pytest.mark.parametrize("old", ["PASS", "WARN", "FAIL"])
@pytest.mark.parametrize("new", ["PASS", "WARN", "FAIL"])
def test_verdict_is_only_ever_lowered(spark, old, new):
    first = RuleFile.of("one", SingleTest("id", "first", f"'{old}' = 'PASS'", old))
    second = RuleFile.of("two", SingleTest("id", "second", f"'{new}' = 'PASS'", new))
    out = validate(validate(spark.range(1), first), second).first()
    order = ["PASS", "WARN", "FAIL"]
    assert verdict(out) == max(old, new, key=order.index)
    assert [d[:2] for d in details(out)] == [("first", old), ("second", new)]


def test_two_files_on_a_null_audit_without_details(spark):
    df = spark.range(2).withColumn(
        "__audit",
        F.expr(
            "CASE WHEN id = 1 THEN named_struct('__transformresult', 'FAIL', '__details', CAST(NULL AS array<struct<"
            "__transformationname: string, __transformresult: string, __transformresult_text: string,"
            " __transformresult_quality: tinyint>>)) END"
        ),
    )
    out = validate(df, RuleFile.of("t", SingleTest("id", "r", "id >= 0"))).orderBy("id").collect()
    assert [verdict(r) for r in out] == ["PASS", "FAIL"]
    assert [len(details(r)) for r in out] == [1, 1]


def test_strict_null_condition_stops(spark):
    df = spark.createDataFrame([(None,)], "v int")
    for rule in (
        SingleTest("v", "r", "v > 0"),
        TestSet("v", "s", "until_passes", [SingleTest("v", "r", "v > 0"), SingleTest("v", "q", "true")]),
    ):
        with pytest.raises(Exception, match="neither true nor false"):
            validate(df, RuleFile.of("t", rule)).collect()


def test_strict_tests_not_reached_are_not_evaluated(spark):
    df = spark.createDataFrame([(None,), (1,)], "v int")
    rules = RuleFile.of(
        "t", TestSet("v", "s", "until_failed", [SingleTest("v", "given", "v IS NOT NULL"), SingleTest("v", "big", "v > 5")])
    )
    out = validate(df, rules).collect()
    assert [[d[:2] for d in details(r)] for r in out] == [[("given", "FAIL")], [("given", "PASS"), ("big", "FAIL")]]


def test_permissive_null_condition(spark):
    df = spark.createDataFrame([(None,), (1,)], "v int")
    rules = RuleFile.of("t", SingleTest("v", "r", "v > 0", "WARN", "7"))
    out = validate(df, rules, mode="permissive", error_column="errors").collect()
    assert [(verdict(r), r["v"], r["errors"]) for r in out] == [("FAIL", None, ["r"]), ("PASS", 1, [])]


def test_non_boolean_condition_is_rejected(spark):
    with pytest.raises(Exception, match="(?i)mismatch|boolean"):
        validate(spark.range(1), RuleFile.of("t", SingleTest("id", "r", "id + 1")))


def test_substitute_is_converted_to_the_field_type(spark):
    df = spark.createDataFrame([(1, "x")], "v int, s string")
    rules = RuleFile.of("t", SingleTest("v", "r", "v > 5", "FAIL", "'12'"), SingleTest("s", "q", "s = 'y'", "FAIL", "v + 1"))
    out = validate(df, rules).first()
    assert (out["v"], out["s"]) == (12, "2")


def test_misplaced_substitutes_are_rejected(spark):
    df = spark.createDataFrame([(1, [1.0])], "v int, l array<double>")
    with pytest.raises(ValueError, match="does not have"):
        validate(df, RuleFile.of("t", SingleTest("w", "r", "v > 5", "FAIL", "1")))
    with pytest.raises(ValueError, match="no field"):
        SingleTest(None, "r", "v > 5", "FAIL", "1")
    with pytest.raises(ValueError, match="primitive"):
        validate(df, RuleFile.of("t", ArrayOf("l", [SingleTest("l", "r", "e > 5", "FAIL", "1")])))


def test_lambda_variables_do_not_hide_columns(spark):
    df = spark.createDataFrame([(1, [(1,)])], "e int, l array<struct<x: int>>")
    with pytest.raises(ValueError, match="hides a column"):
        validate(df, RuleFile.of("t", ArrayOf("l", [SingleTest("x", "r", "{x} > 0")])))
    out = validate(df, RuleFile.of("t", ArrayOf("l", [SingleTest("x", "r", "el.x = e")], element="el"))).first()
    assert details(out) == [("r", "PASS", "l[0].x", 100)]


def test_column_formulas(spark):
    df = spark.createDataFrame([(1,), (9,)], "v int")
    rules = RuleFile.of("t", SingleTest("v", "small", F.col("v") < 5, "WARN", F.lit(4)))
    out = validate(df, rules).collect()
    assert [(verdict(r), r["v"]) for r in out] == [("PASS", 1), ("WARN", 4)]
    assert validate(df, rules).columns == ["v", "__audit"]


def test_arrays_of_primitives_give_one_row_per_element(spark):
    df = spark.createDataFrame([([1.0, 9.0], 1), ([], 2), (None, 3)], "l array<double>, id int")
    out = by_id(validate(df, RuleFile.of("t", ArrayOf("l", [SingleTest("l", "small", "e < 5"), SingleTest("l", "low id", "id < 2")]))))
    assert [d[:3] for d in details(out[1])] == [
        ("small", "PASS", "l"), ("low id", "PASS", "l"), ("small", "FAIL", "l"), ("low id", "PASS", "l"),
    ]
    assert details(out[2]) == [] and details(out[3]) == []


def test_nested_arrays_records_and_unions(spark):
    schema = "id int, r struct<k: int, l: array<struct<x: int, m: array<struct<y: int>>>>>, u struct<member0: struct<z: int>, member1: string>"
    df = spark.createDataFrame(
        [
            (1, (5, [(1, [(1,), (2,)]), (2, None)]), ((7,), None)),
            (2, (None, None), (None, "text")),
            (3, None, None),
        ],
        schema,
    )
    rules = RuleFile.of(
        "t",
        RecordOf(
            "r",
            [
                SingleTest("k", "k given", "{k} IS NOT NULL", "WARN", "{parent.id}"),
                ArrayOf(
                    "l",
                    [
                        SingleTest("x", "x one", "{x} = 1", "PASS", "{parent.parent.k} * 10"),
                        ArrayOf("m", [SingleTest("y", "y below x", "{y} < 2 * {parent.parent.x}", "FAIL", "{parent.parent.x} + {parent.parent.parent.parent.k}")]),
                    ],
                ),
                Generic([SingleTest(None, "any", "{k} IS NULL OR {parent.id} = 1")]),
            ],
        ),
        UnionOf("u", {"member0": RecordOf(None, [SingleTest("z", "z even", "{z} % 2 = 0", "WARN", "0")]),
                      "member1": SingleTest("u", "text", "u.member1 = 'text'"),
                      None: SingleTest("u", "nothing", "id = 3")}),
    )
    out = by_id(validate(df, rules))
    assert details(out[1]) == [
        ("k given", "PASS", "r.k", 100),
        ("x one", "PASS", "r.l[0].x", 100),
        ("y below x", "PASS", "r.l[0].m[0].y", 100),
        ("y below x", "FAIL", "r.l[0].m[1].y", 0),
        ("x one", "PASS", "r.l[1].x", 100),
        ("any", "PASS", "r", 100),
        ("z even", "WARN", "u.z", 90),
    ]
    assert out[1]["r"].asDict(True) == {"k": 5, "l": [{"x": 1, "m": [{"y": 1}, {"y": 6}]}, {"x": 50, "m": None}]}
    assert out[1]["u"]["member0"]["z"] == 0
    assert [d[:3] for d in details(out[2])] == [("k given", "WARN", "r.k"), ("any", "PASS", "r"), ("text", "PASS", "u")]
    assert out[2]["r"]["k"] == 2
    assert [d[:3] for d in details(out[3])] == [("nothing", "PASS", "u")]
    assert out[3]["r"] is None


def test_enclosing_scope_writes_to_the_outer_record(spark):
    df = spark.createDataFrame([(1, "outer", ("inner",))], "id int, city string, r struct<city: string>")
    rules = RuleFile.of("t", RecordOf("r", [SingleTest("city", "c", "{city} = 'x'", "FAIL", "'new'")]))
    record = validate(df, rules).first()
    assert (record["city"], record["r"]["city"], details(record)[0][2]) == ("outer", "new", "r.city")
    enclosing = validate(df, rules, nested_scope="enclosing").first()
    assert (enclosing["city"], enclosing["r"]["city"], details(enclosing)[0][2]) == ("new", "inner", "city")


def test_steps_see_earlier_changes(spark):
    df = spark.createDataFrame([(1, 212.0, "F"), (2, 30.0, "C"), (3, 500.0, "F"), (4, 1.0, "K")], "id int, heat double, unit string")
    celsius = [SingleTest("heat", "in C", "unit <> 'F'", "PASS", "round((heat - 32) / 1.8, 1)"), SingleTest("unit", "C", "unit <> 'F'", "PASS", "'C'")]
    steps = (
        Step("convert", celsius), Step("judge", [SingleTest("heat", "bearable", "heat <= 100", "WARN"), SingleTest("unit", "known", "unit = 'C'")]),
        Step("cut", [SingleTest("heat", "at most 100", "heat <= 100", "PASS", "100")]),
    )
    out = by_id(validate(df, RuleFile("t", steps)))
    assert {n: (r["heat"], r["unit"], verdict(r)) for n, r in out.items()} == {
        1: (100.0, "C", "PASS"), 2: (30.0, "C", "PASS"), 3: (100.0, "C", "WARN"), 4: (1.0, "K", "FAIL")}
    assert all(len(details(r)) == 5 for r in out.values())


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_names_with_quotes(spark):
    df = spark.createDataFrame([(1,)], "`odd ``name` int")
    rules = RuleFile.of("it's", SingleTest("odd `name", "it's a \\ \"rule\"", "`odd ``name` > 0", "FAIL", "2"))
    assert details(validate(df, rules).first()) == [("it's a \\ \"rule\"", "PASS", "odd `name", 100)]


def test_comments_in_formulas(spark):
    rules = RuleFile.of("t", SingleTest("id", "r", "id > 5 -- large", "WARN", "7 -- lucky"))
    assert [(verdict(r), r["id"]) for r in validate(spark.range(1), rules).collect()] == [("WARN", 7)]


SAMPLE = """{"rulesteps": [{"type": "RuleStep", "fieldname": "s", "rules": [
  {"type": "PrimitiveRule", "fieldname": "a", "rulename": "r", "condition": "a > 5", "substitute": "a * 2", "sampleinput": "3"},
  {"type": "EmptyRule", "fieldname": "b", "sampleinput": 1.5},
  {"type": "RecordRule", "fieldname": "r", "rules": [{"type": "EmptyRule", "fieldname": "c", "sampleinput": "x"}]},
  {"type": "ArrayRule", "fieldname": "l", "rules": [{"type": "RecordRule", "fieldname": "l", "rules": [
     {"type": "PrimitiveRule", "fieldname": "x", "rulename": "q", "condition": "{x} IS NULL", "sampleinput": 4}]}]},
  {"type": "UnionRule", "fieldname": "u", "rules": [{"type": "EmptyRule", "fielddatatype": "NULL"},
     {"type": "EmptyRule"}, {"type": "EmptyRule", "sampleinput": "text"}]},
  {"type": "GenericRules", "fieldname": "(more)", "rules": [{"type": "EmptyRule"}]}]}]}"""


def test_dry_run_on_sample_values(spark):
    schema = "a int, b double, r struct<c: string>, l array<struct<x: int>>, u struct<member0: int, member1: string>"
    schema = spark.createDataFrame([], schema).schema
    record = sample_record(spark, sample_values(SAMPLE), schema)
    assert record.first().asDict(True) == {
        "a": 3, "b": 1.5, "r": {"c": "x"}, "l": [{"x": 4}], "u": {"member0": None, "member1": "text"},
    }
    rows = trace(record, parse_rule_file(SAMPLE), ["a"], step=0).drop("step", "rule_no", "kind").collect()
    assert [tuple(r) for r in rows] == [
        (3, "r", "a", "3", "6", "FAIL", None),
        (3, "q", "l[0].x", "4", "4", "FAIL", None),
    ]


def test_two_array_rules_on_one_array(spark):
    df = spark.createDataFrame([(1, [(1, 1, [(1,)]), (5, 5, None)])], "id int, l array<struct<x: int, y: int, m: array<struct<z: int>>>>")
    rules = RuleFile.of(
        "t",
        ArrayOf("l", [SingleTest("x", "a", "{x} > 3", "WARN", "10"), ArrayOf("m", [SingleTest("z", "m1", "{z} > 1", "PASS", "20")])]),
        SingleTest("id", "between", "id = 1"),
        ArrayOf("l", [SingleTest("x", "b", "{x} > 4", "FAIL", "30"), SingleTest("y", "c", "{y} < 3", "PASS", "{x} + 40"),
                      ArrayOf("m", [SingleTest("z", "m2", "{z} > 2", "PASS", "{parent.parent.x} + 50")])]),
    )
    out = validate(df, rules).first()
    assert [d[0] for d in details(out)] == ["a", "m1", "a", "between", "b", "c", "m2", "b", "c"]
    assert [e.asDict(True) for e in out["l"]] == [{"x": 30, "y": 1, "m": [{"z": 51}]}, {"x": 5, "y": 45, "m": None}]
