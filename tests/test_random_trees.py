"""Random rule trees on random records against a row-by-row reading of the rules."""

import random

import pytest
from audit_helpers import details, verdict

from ruleloom import ArrayOf, Generic, RecordOf, RuleFile, SingleTest, Step, TestSet, validate
from ruleloom.operators.dryrun import trace
from ruleloom.operators.reports import rule_summary, stored_rule_summary

SCHEMA = "id int, a int, b int, r struct<c: int, d: int>, l array<struct<x: int, y: int>>"
QUALITY = {"PASS": 100, "WARN": 90, "FAIL": 0}


class Place:
    """A record, its path and the change requests collected for it."""

    def __init__(self, values, path="", parent=None):
        self.values, self.path, self.parent, self.changes = values, path, parent, {}

    def text(self, field):
        if field is None:
            return self.path or None
        return f"{self.path}.{field}" if self.path else field


def value_of(place, name):
    while name.startswith("parent."):
        place, name = place.parent, name.removeprefix("parent.")
    return place.values[name]


def holds(condition, place):
    name, operator, constant = condition
    value = value_of(place, name)
    if operator == "null":
        return value is None
    if value is None:
        return None
    return value < constant if operator == "<" else value % constant == 0


def sql(condition, inside_array):
    name, operator, constant = condition
    # the parent of an element is the array, whose parent is the record
    ref = "{" + (name.replace("parent.", "parent.parent.") if inside_array else name) + "}"
    return {"null": f"{ref} IS NULL", "<": f"{ref} < {constant}", "%": f"{ref} % {constant} = 0"}[operator]


class Walk:
    def __init__(self):
        self.rows, self.errors = [], 0

    def test(self, rule, place):
        name, field, condition, if_false, change = rule
        if condition is None:
            return "PASS"
        result = holds(condition, place)
        if result is None:
            outcome = "FAIL"
            self.errors += 1
        elif result:
            outcome = "PASS"
        else:
            outcome = if_false
            if change is not None:
                place.changes[field] = change
        self.rows.append((name, outcome, place.text(field), QUALITY[outcome]))
        return outcome

    def rule(self, rule, place):
        if rule[0] != "set":
            return self.test(rule, place)
        _, mode, children = rule
        outcomes = []
        for child in children:
            outcomes.append(self.rule(child, place))
            if mode == "until_failed" and outcomes[-1] == "FAIL" or mode == "until_passes" and outcomes[-1] == "PASS":
                break
        if mode == "until_passes":
            return outcomes[-1] if outcomes else "FAIL"
        return max(outcomes, key=["PASS", "WARN", "FAIL"].index, default="PASS")


class Maker:
    """Makes one random rule both as a plain tuple and as a rule object."""

    def __init__(self, seed):
        self.random, self.count = random.Random(seed), 0

    def condition(self, names):
        kind = self.random.choice(["null", "<", "<", "%"])
        return (self.random.choice(names), kind, self.random.randint(1, 6))

    def test(self, names, fields, inside_array):
        self.count += 1
        field = self.random.choice(fields)
        condition = None if self.random.random() < 0.08 else self.condition(names)
        if_false = self.random.choice(["FAIL", "WARN", "PASS"])
        change = self.random.randint(0, 9) if field and condition and self.random.random() < 0.4 else None
        plain = (f"rule {self.count}", field, condition, if_false, change)
        formula = None if condition is None else sql(condition, inside_array)
        return plain, SingleTest(field, plain[0], formula, if_false, None if change is None else str(change))

    def any(self, names, fields, inside_array, depth):
        if depth == 0 or self.random.random() < 0.5:
            return self.test(names, fields, inside_array)
        mode = self.random.choice(["all", "until_failed", "until_passes"])
        children = [self.any(names, fields, inside_array, depth - 1) for _ in range(self.random.randint(0, 4))]
        self.count += 1
        made = TestSet(fields[0], f"set {self.count}", mode, [c[1] for c in children])
        return ("set", mode, [c[0] for c in children]), made

    def several(self, names, fields, inside_array=False, depth=2):
        return [self.any(names, fields, inside_array, depth) for _ in range(self.random.randint(1, 3))]

    def step(self, number):
        outer, nested, element = ["id", "a", "b"], ["c", "d", "parent.a"], ["x", "y", "parent.b"]
        plan = [("root", self.several(outer, ["a", "b"]))]
        plan.append(("record", self.several(nested, ["c", "d"])))
        plan.append(("array", self.several(element, ["x", "y"], True)))
        plan.append(("generic", self.several(outer, [None])))
        self.random.shuffle(plan)
        rules = []
        for kind, children in plan:
            made = [c[1] for c in children]
            if kind == "root":
                rules += made
            else:
                rules.append({"record": RecordOf("r", made), "array": ArrayOf("l", made), "generic": Generic(made)}[kind])
        return [(k, [c[0] for c in children]) for k, children in plan], Step(f"step {number}", rules)


def run(steps, record):
    """(audit rows, top-level results, record after all steps, conditions without result)"""
    walk, tops = Walk(), []
    values = dict(record)
    for plan in steps:
        root = Place(values)
        inner = Place(values["r"], "r", root) if values["r"] is not None else None
        elements = [Place(e, f"l[{n}]", root) for n, e in enumerate(values["l"] or []) if e is not None]
        for kind, rules in plan:
            places = {"root": [root], "generic": [root], "record": [inner] if inner else [], "array": elements}[kind]
            for place in places:
                tops += [walk.rule(rule, place) for rule in rules]
        values = {**values, **root.changes}
        if inner:
            values["r"] = {**inner.values, **inner.changes}
        if values["l"] is not None:
            changed = iter({**p.values, **p.changes} for p in elements)
            values["l"] = [None if e is None else next(changed) for e in values["l"]]
    return walk.rows, tops, values, walk.errors


def records(rng, count=25):
    def number():
        return None if rng.random() < 0.15 else rng.randint(0, 9)

    def listed():
        if rng.random() < 0.15:
            return None
        return [None if rng.random() < 0.1 else {"x": number(), "y": number()} for _ in range(rng.randint(0, 3))]

    return [
        {"id": n, "a": number(), "b": number(), "r": None if rng.random() < 0.2 else {"c": number(), "d": number()}, "l": listed()}
        for n in range(count)
    ]


def worst(results):
    return max(results, key=["PASS", "WARN", "FAIL"].index, default="PASS")


@pytest.mark.parametrize("seed", range(12))
def test_random_tree(spark, seed):
    maker = Maker(seed)
    made = [maker.step(n) for n in (1, 2)]
    rules = RuleFile("random", [m[1] for m in made])
    steps = [m[0] for m in made]
    data = records(maker.random)
    df = spark.createDataFrame(data, SCHEMA)
    out = {r["id"]: r for r in validate(df, rules, mode="permissive", error_column="errors").collect()}
    sets = {r["id"]: verdict(r) for r in validate(df, rules, mode="permissive", verdict="sets", details="none").collect()}
    brief = {r["id"]: r for r in validate(df, rules, mode="permissive", details="not_passed").collect()}
    strict_rows = []
    for record in data:
        rows, tops, values, errors = run(steps, record)
        got = out[record["id"]]
        assert details(got) == rows, record
        assert verdict(got) == worst(r[1] for r in rows)
        assert sets[record["id"]] == worst(tops), record
        assert details(brief[record["id"]]) == [r for r in rows if r[1] != "PASS"]
        assert verdict(brief[record["id"]]) == verdict(got)
        assert len(got["errors"]) == errors
        assert {k: v for k, v in got.asDict(True).items() if k not in ("__audit", "errors")} == values, record
        if not errors:
            strict_rows.append((record, rows, values))
    if strict_rows:
        fine = spark.createDataFrame([r for r, _, _ in strict_rows], SCHEMA)
        strict = {r["id"]: r for r in validate(fine, rules).collect()}
        for record, rows, values in strict_rows:
            assert details(strict[record["id"]]) == rows
            assert {k: v for k, v in strict[record["id"]].asDict(True).items() if k != "__audit"} == values
    executed = [r for r in trace(df, rules, ["id"]).where("kind = 'test' AND result IS NOT NULL").collect()]
    named = sorted((r["id"], r["rule"], r["result"], r["text"] or "") for r in executed)
    silent = {name for name in silent_names(steps)}
    wanted = sorted((i, d[0], d[1], d[2] or "") for i, row in out.items() for d in details(row))
    assert [n for n in named if n[1] not in silent] == wanted


def silent_names(rules):
    for rule in rules:
        if isinstance(rule, list):
            yield from silent_names(rule)
        elif rule[0] == "set":
            yield from silent_names(rule[2])
        elif rule[0] in ("root", "record", "array", "generic"):
            yield from silent_names(rule[1])
        elif rule[2] is None:
            yield rule[0]


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("with_arrays", [True, False])
def test_summaries_agree_with_stored_audits(spark, seed, with_arrays):
    maker = Maker(seed)
    step = maker.step(1)[1]
    rules = RuleFile("random", [Step("s", [r for r in step.rules if with_arrays or not isinstance(r, ArrayOf)])])
    df = spark.createDataFrame(records(maker.random, 40), SCHEMA)
    direct = rule_summary(df, rules, mode="permissive")
    stored = stored_rule_summary(validate(df, rules, mode="permissive"))
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, stored.collect()))
