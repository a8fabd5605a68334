"""From a rule step and a record type to SQL expressions.

Every test yields one small integer, its *code*; codes of neighbouring tests
share an ``array<tinyint>`` and arrays of records yield an array of structs of
such arrays.  Names, paths and severities never enter the rows: they are known
here and are only attached where details are wanted.

    -1  condition false, severity PASS        1  condition false, severity WARN
     0  condition true                        2  condition false, severity FAIL
     3  condition neither true nor false (permissive mode only)
     NULL  test not executed
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

from ..model import ArrayOf, Generic, RecordOf, SingleTest, Step, TestSet, UnionOf
from .scope import Place, root_place
from .sqltext import all_of, array, ddl, greatest, literal, quote, struct, when

# A substitute that may give NULL on purpose says so.
_MEANS_NULL = re.compile(r"\b(null|nullif)\b", re.IGNORECASE)

WAIVED, PASS, WARN, FAIL, ERROR = -1, 0, 1, 2, 3
CODE_IF_FALSE = {"PASS": WAIVED, "WARN": WARN, "FAIL": FAIL}
NOT_BOOLEAN = "the condition gave neither true nor false"
NO_NEW_VALUE = "the new value could not be made, the old one stays"


@dataclass(frozen=True)
class Options:
    mode: str = "strict"  # strict | permissive
    nested_scope: str = "record"  # record | enclosing
    qualify_names: bool = False
    any_type: bool = False  # a condition of another type than boolean counts as no result

    def __post_init__(self):
        for name, allowed in (("mode", ("strict", "permissive")), ("nested_scope", ("record", "enclosing"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")

    @property
    def permissive(self) -> bool:
        return self.mode == "permissive"


@dataclass
class Test:
    """One single test at its place in the record."""

    __test__ = False

    rule: SingleTest
    name: str
    path: tuple[str, ...]
    container: Place
    condition: str | None
    code: str
    conditional: bool
    marks_set: bool = False  # no test, only tells that an empty set was reached
    group: "TestGroup" = None
    position: int = 0

    @property
    def code_if_false(self) -> int:
        return CODE_IF_FALSE[self.rule.if_false]

    @property
    def silent(self) -> bool:
        """A test without a condition passes and leaves no trace in the audit."""
        return self.condition is None

    def read(self) -> str:
        return f"get({self.group.ref}, {self.position})"


@dataclass
class TestGroup:
    """Neighbouring tests of one record; ``ref`` is the SQL text of their codes."""

    ref: str
    tests: list[Test] = field(default_factory=list)

    def codes(self) -> str:
        return array([f"CAST({t.code} AS TINYINT)" for t in self.tests])

    @property
    def conditional(self) -> bool:
        return any(t.conditional or t.silent for t in self.tests)


@dataclass
class ElementGroup:
    """The tests run for each element of one array."""

    ref: str
    source: Place
    element: str
    index: str
    guards: list[str]
    body: "Record"

    def codes(self) -> str:
        inner = self.body.codes_struct()
        if isinstance(self.source.dtype.elementType, T.StructType):
            inner = f"CASE WHEN {self.element} IS NOT NULL THEN {inner} END"
        return when(self.guards, f"transform({self.source.ref}, ({self.element}, {self.index}) -> {inner})")


@dataclass
class Decision:
    """The number of the child a test set stopped at, one more than its children if none."""

    name: str
    sql: str


@dataclass
class SetResult:
    """A test set and the SQL text of its result."""

    rule: TestSet
    name: str
    path: tuple[str, ...]
    container: Place
    sql: str


class Record:
    """All groups of one record, in execution order."""

    def __init__(self, depth: int, prefix: str, codes_ref: str | None, place: Place):
        self.depth, self.prefix, self.codes_ref, self.place = depth, prefix, codes_ref, place
        self.groups: list[TestGroup | ElementGroup] = []
        self.decisions: list[list[Decision]] = []
        self.sets: list[SetResult] = []
        self.tops: list[str] = []  # result code of every outermost test or set

    def _new_ref(self) -> str:
        name = f"s{len(self.groups)}"
        return quote(self.prefix + name) if self.codes_ref is None else f"{self.codes_ref}.{name}"

    def add_test(self, test: Test) -> None:
        if not self.groups or not isinstance(self.groups[-1], TestGroup):
            self.groups.append(TestGroup(self._new_ref()))
        group = self.groups[-1]
        test.group, test.position = group, len(group.tests)
        group.tests.append(test)

    def add_decision(self, level: int, sql: str) -> str:
        """Keep ``sql`` for evaluation before the codes; returns how to read it."""
        while len(self.decisions) <= level:
            self.decisions.append([])
        name = f"t{level}_{len(self.decisions[level])}"
        self.decisions[level].append(Decision(name, sql))
        return quote(self.prefix + name) if self.codes_ref is None else f"{self._let(level)}.{name}"

    def _let(self, level: int) -> str:
        return f"t{self.depth}_{level}"

    def codes_struct(self) -> str:
        """Codes of one element.  Decisions are bound by one-element lambdas, so each runs once."""
        body = struct({f"s{n}": g.codes() for n, g in enumerate(self.groups)})
        for level in reversed(range(len(self.decisions))):
            bound = struct({d.name: d.sql for d in self.decisions[level]})
            body = f"get(transform({array([bound])}, {self._let(level)} -> {body}), 0)"
        return body

    def tests(self):
        """Every test of the record, those of array elements included."""
        for group in self.groups:
            if isinstance(group, TestGroup):
                yield from group.tests
            else:
                yield from group.body.tests()

    def worst(self) -> str | None:
        """The highest code of the record, NULL if no test ran."""
        found = []
        for group in self.groups:
            if isinstance(group, TestGroup):
                found.append(f"array_max({group.ref})")
            else:
                inner = group.body.worst()
                if inner:
                    found.append(f"array_max(transform({group.ref}, {group.body.codes_ref} -> {inner}))")
        return greatest(found) if found else None

    def worst_of_sets(self) -> str | None:
        """Like ``worst`` with the results of the outermost tests and sets."""
        found = list(self.tops)
        for group in self.groups:
            if isinstance(group, ElementGroup):
                inner = group.body.worst_of_sets()
                if inner:
                    found.append(f"array_max(transform({group.ref}, {group.body.codes_ref} -> {inner}))")
        return greatest(found) if found else None


class StepLowering:
    """Walks the rules of one step and fills a ``Record``."""

    def __init__(self, step: Step, schema: T.StructType, options: Options, prefix: str):
        self.step, self.options, self.prefix = step, options, prefix
        self.formula_columns: dict[str, Column] = {}
        self.root = root_place(schema)
        self.record = Record(0, prefix, None, self.root)
        for rule in step.rules:
            self._lower(rule, self._value_of(rule, self.root), self.root, self.record, [], None)

    # -- formulas ---------------------------------------------------------

    def _formula(self, formula, container: Place, what: str) -> str:
        if isinstance(formula, Column):
            if not container.is_root:
                raise ValueError(f"{what}: a formula inside a nested record or array must be SQL text")
            for name, known in self.formula_columns.items():
                if known is formula:
                    return quote(name)
            name = f"{self.prefix}f{len(self.formula_columns)}"
            self.formula_columns[name] = formula
            return quote(name)
        # a comment at the end must not swallow what follows the formula
        return container.bind(formula) + ("\n" if "--" in formula else "")

    def _condition(self, rule: SingleTest, container: Place) -> str | None:
        if rule.condition is None:
            return None
        condition = self._formula(rule.condition, container, rule.name)
        if self.options.any_type:
            condition = f"CASE WHEN typeof({condition}) = 'boolean' THEN CAST(CAST({condition} AS STRING) AS BOOLEAN) END"
        return condition

    def _truth(self, rule: SingleTest, condition: str) -> str:
        if self.options.permissive:
            return f"coalesce({condition}, false)"
        return f"coalesce({condition}, {self._no_result(rule)})"

    def _no_result(self, rule: SingleTest) -> str:
        message = f"Rule '{rule.name}': {NOT_BOOLEAN}"
        if isinstance(rule.condition, str):
            message += f": {rule.condition}"
        return f"raise_error({literal(message)})"

    def _code(self, rule: SingleTest, condition: str, container: Place) -> str:
        otherwise = CODE_IF_FALSE[rule.if_false]
        if self.options.permissive:
            if rule.substitute is not None:
                otherwise = f"CASE WHEN {self._bad_substitute(rule, container)} THEN {ERROR} ELSE {otherwise} END"
            return f"CASE WHEN {condition} THEN {PASS} WHEN NOT ({condition}) THEN {otherwise} ELSE {ERROR} END"
        return f"CASE WHEN {self._truth(rule, condition)} THEN {PASS} ELSE {otherwise} END"

    # -- when a child ends its set -----------------------------------------

    def _passes(self, rule, container: Place) -> str:
        if isinstance(rule, SingleTest):
            condition = self._condition(rule, container)
            if condition is None:
                return "true"
            if rule.if_false == "PASS":
                return f"({condition}) IS NOT NULL" if self.options.permissive else "true"
            return self._truth(rule, condition)
        children = [self._passes(r, container) for r in rule.rules]
        if rule.mode == "until_passes":
            return self._first(children, "true", "false")
        return self._first([f"NOT ({c})" for c in children], "false", "true")

    def _fails(self, rule, container: Place) -> str:
        if isinstance(rule, SingleTest):
            condition = self._condition(rule, container)
            if condition is None:
                return "false"
            if rule.if_false == "FAIL":
                return f"NOT ({self._truth(rule, condition)})"
            return f"({condition}) IS NULL" if self.options.permissive else "false"
        if rule.mode == "until_passes":
            if not rule.rules:
                return "true"
            passed = [self._passes(r, container) for r in rule.rules[:-1]]
            return self._first(passed, "false", self._fails(rule.rules[-1], container))
        return self._first([self._fails(r, container) for r in rule.rules], "true", "false")

    @staticmethod
    def _first(predicates: list[str], then: str, otherwise: str) -> str:
        if not predicates:
            return otherwise
        return "CASE " + " ".join(f"WHEN {p} THEN {then}" for p in predicates) + f" ELSE {otherwise} END"

    # -- the walk -----------------------------------------------------------

    def _value_of(self, rule, place: Place) -> Place:
        """The value a rule looks at: the field it is named after, else the record."""
        name = getattr(rule, "field", None)
        if isinstance(rule, (ArrayOf, RecordOf, UnionOf)) and name is not None:
            return place.child(name)
        return place

    def _lower(self, rule, value: Place, container: Place, record: Record, guards: list[str], path_name):
        if isinstance(rule, SingleTest):
            record.tops += self._test(rule, container, record, guards, path_name)
        elif isinstance(rule, TestSet):
            record.tops += self._set(rule, container, record, guards, path_name, 0)
        elif isinstance(rule, Generic):
            for child in rule.rules:
                self._lower(child, value, value, record, guards, path_name)
        elif isinstance(rule, RecordOf):
            self._record(rule, value, container, record, guards)
        elif isinstance(rule, ArrayOf):
            self._array(rule, value, container, record, guards)
        elif isinstance(rule, UnionOf):
            self._union(rule, value, container, record, guards)
        else:
            raise TypeError(f"not a rule: {rule!r}")

    def _record(self, rule: RecordOf, value: Place, container: Place, record: Record, guards: list[str]):
        if not isinstance(value.dtype, T.StructType):
            raise ValueError(f"field {rule.field!r} is not a record")
        inner = value if self.options.nested_scope == "record" else container
        if not value.is_root:
            guards = guards + [f"{value.ref} IS NOT NULL"]
        for child in rule.rules:
            self._lower(child, self._value_of(child, value), inner, record, guards, None)

    def _array(self, rule: ArrayOf, value: Place, container: Place, record: Record, guards: list[str]):
        if not isinstance(value.dtype, T.ArrayType):
            raise ValueError(f"field {rule.field!r} is not an array")
        depth = record.depth + 1
        suffix = "" if depth == 1 else str(depth)
        element, index = rule.element or "e" + suffix, rule.index or "i" + suffix
        for name in (element, index):
            if name in self.root.names():
                raise ValueError(
                    f"the lambda variable {name!r} of array {rule.field!r} hides a column of that name; "
                    "give ArrayOf another element= or index="
                )
        place = value.element(element, index)
        of_records = isinstance(place.dtype, T.StructType)
        body = Record(depth, self.prefix, f"x{depth}_{len(record.groups)}", place)
        children = rule.rules
        if of_records:
            # one record rule around the fields of the element says nothing more
            children = [c for r in rule.rules for c in (r.rules if isinstance(r, RecordOf) and r.field is None else [r])]
        for child in children:
            inner = place if of_records else container
            if not of_records and _has_substitute(child):
                raise ValueError(f"tests on the primitive elements of {rule.field!r} cannot have a substitute")
            self._lower(child, self._value_of(child, place), inner, body, [], None)
        if body.groups:
            record.groups.append(ElementGroup(record._new_ref(), value, element, index, guards, body))

    def _union(self, rule: UnionOf, value: Place, container: Place, record: Record, guards: list[str]):
        if not isinstance(value.dtype, T.StructType):
            raise ValueError(f"field {rule.field!r} is not a union held as a struct of members")
        members = {name: value.member(name) for name in value.names()}
        for name, child in rule.branches:
            if name is None:
                empty = all_of([f"{m.ref} IS NULL" for m in members.values()])
                self._lower(child, value, container, record, guards + [empty], None)
            else:
                if name not in members:
                    raise ValueError(f"union {rule.field!r} has no member {name!r}, only {list(members)}")
                present = f"{members[name].ref} IS NOT NULL"
                self._lower(child, members[name], container, record, guards + [present], None)

    def _test(self, rule: SingleTest, container: Place, record: Record, guards, path_name, code=None) -> list[str]:
        condition = self._condition(rule, container)
        if condition is None and code is None and not guards:
            return []
        if rule.substitute is not None and rule.field not in container.names():
            raise ValueError(f"test {rule.name!r} changes {rule.field!r}, which {container.describe()} does not have")
        qualified = self.options.qualify_names and path_name
        decided = code is not None
        if not decided:
            code = str(PASS) if condition is None else self._code(rule, condition, container)
        test = Test(
            rule=rule,
            name=f"{path_name}/{rule.name}" if qualified else rule.name,
            path=container.path_of(rule.field),
            container=container,
            condition=condition,
            code=when(guards, code),
            conditional=bool(guards) or decided,
        )
        record.add_test(test)
        return [test.read()]

    def _set(self, rule: TestSet, container: Place, record: Record, guards, path_name, level: int) -> list[str]:
        name = f"{path_name}/{rule.name}" if path_name else rule.name
        ends = []
        if rule.mode == "until_failed":
            ends = [self._fails(r, container) for r in rule.rules]
        elif rule.mode == "until_passes":
            ends = [self._passes(r, container) for r in rule.rules]
        stop = None
        if any(e != "false" for e in ends[:-1]) or (ends and rule.mode == "until_passes"):
            cases = " ".join(f"WHEN {e} THEN {n}" for n, e in enumerate(ends, 1) if e != "false")
            stop = record.add_decision(level, when(guards, f"CASE {cases} ELSE {len(ends) + 1} END"))
        results = []
        for number, child in enumerate(rule.rules, 1):
            reached = guards if stop is None else [f"{stop} >= {number}"]
            if isinstance(child, TestSet):
                results.append(self._set(child, container, record, reached, name, level + (stop is not None)))
            else:
                code = self._code_from_stop(rule.mode, child, stop, number) if stop else None
                results.append(self._test(child, container, record, [] if code else reached, name, code))
        flat = [r[0] for r in results if r]
        if not flat:
            never_passed = rule.mode == "until_passes" and not rule.rules
            result = self._empty_set(rule, container, record, guards, FAIL if never_passed else PASS)
        elif rule.mode == "until_passes":
            # the last test that ran decides, and tests not reached are NULL
            result = f"coalesce({', '.join(reversed(flat))})"
        else:
            result = greatest(flat)
        shown = name if self.options.qualify_names else rule.name
        record.sets.append(SetResult(rule, shown, container.path_of(rule.field), container, result))
        return [result]

    def _empty_set(self, rule: TestSet, container: Place, record: Record, guards, result: int) -> str:
        """The result of a set without tests; where it may not be reached, a slot tells whether it was."""
        if not guards:
            return str(result)
        marker = SingleTest(None, rule.name, None)
        test = Test(marker, rule.name, (), container, None, when(guards, str(PASS)), True, marks_set=True)
        record.add_test(test)
        return f"CASE WHEN {test.read()} IS NOT NULL THEN {result} END"

    def _code_from_stop(self, mode: str, child: SingleTest, stop: str, number: int) -> str | None:
        """The code where it follows from the stop alone, so the condition is not evaluated again."""
        if child.condition is None:
            return f"CASE WHEN {stop} >= {number} THEN {PASS} END"
        if self.options.permissive:
            return None
        if mode == "until_passes" and child.if_false != "PASS":
            return f"CASE WHEN {stop} > {number} THEN {CODE_IF_FALSE[child.if_false]} WHEN {stop} = {number} THEN {PASS} END"
        if mode == "until_failed" and child.if_false == "FAIL":
            return f"CASE WHEN {stop} > {number} THEN {PASS} WHEN {stop} = {number} THEN {FAIL} END"
        return None

    # -- changed values -------------------------------------------------------

    def changes(self) -> dict[str, str]:
        """New SQL text for every column of the outermost record a substitute reaches."""
        wanted: dict[str, list[Test]] = {}
        for test in self.record.tests():
            if test.rule.substitute is not None and not test.silent:
                wanted.setdefault(test.container.id, []).append(test)
        return self._rebuild_fields(self.root, self.record.groups, wanted) if wanted else {}

    def _rebuild_fields(self, place: Place, groups: list, wanted) -> dict[str, str]:
        """Changed fields of ``place``: its own substitutes first, then those further inside."""
        own = wanted.get(place.id, [])
        changed = {}
        for struct_field in place.dtype.fields:
            name = struct_field.name
            here = place.child(name)
            inside = self._rebuild(here, groups, wanted)
            tests = [t for t in own if t.rule.field == name]
            if not tests and inside is None:
                continue
            otherwise = inside or here.ref
            cases = " ".join(
                f"WHEN {t.read()} = {t.code_if_false} THEN {self.new_value(t)}" for t in reversed(tests)
            )
            changed[name] = f"CASE {cases} ELSE {otherwise} END" if tests else otherwise
        return changed

    def _rebuild(self, place: Place, groups: list, wanted) -> str | None:
        if isinstance(place.dtype, T.StructType):
            changed = self._rebuild_fields(place, groups, wanted)
            if not changed:
                return None
            rebuilt = struct({n: changed.get(n) or place.read(n) for n in place.names()})
            return f"CASE WHEN {place.ref} IS NOT NULL THEN {rebuilt} END"
        if isinstance(place.dtype, T.ArrayType):
            groups = [g for g in groups if isinstance(g, ElementGroup) and g.source.id == place.id]
            if not groups:
                return None
            element, index = groups[0].element, groups[0].index
            inside = [inner for g in groups for inner in g.body.groups]
            rebuilt = self._rebuild(place.element(element, index), inside, wanted)
            if rebuilt is None:
                return None
            if any((g.element, g.index) != (element, index) for g in groups):
                raise ValueError(f"array rules on {place.ref} in one step must use the same element and index names")
            for group in reversed(groups):
                # the codes of an element stand at the same index of the codes array
                rebuilt = f"get(transform(array(get({group.ref}, {index})), {group.body.codes_ref} -> {rebuilt}), 0)"
            return f"transform({place.ref}, ({element}, {index}) -> {rebuilt})"
        return None

    def new_value(self, test: Test) -> str:
        return self._new_value(test.rule, test.container)

    def _new_value(self, rule: SingleTest, container: Place) -> str:
        value = self._formula(rule.substitute, container, rule.name)
        cast = "try_cast" if self.options.permissive else "CAST"
        return f"{cast}({value} AS {ddl(container.dtype[rule.field].dataType)})"

    def _bad_substitute(self, rule: SingleTest, container: Place) -> str:
        """Whether the new value would be a NULL that the formula did not mean."""
        new = self._new_value(rule, container)
        if isinstance(rule.substitute, str) and _MEANS_NULL.search(rule.substitute):
            return f"({new}) IS NULL AND ({self._formula(rule.substitute, container, rule.name)}) IS NOT NULL"
        return f"({new}) IS NULL"


def _has_substitute(rule) -> bool:
    if isinstance(rule, SingleTest):
        return rule.substitute is not None
    return any(_has_substitute(r) for r in getattr(rule, "rules", ()))
