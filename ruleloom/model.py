"""Rule files as plain, immutable Python objects.

A formula is Spark SQL text.  Inside a formula ``{name}`` stands for a field of
the record the rule sits in and ``{parent.name}`` walks outwards, so the same
text works at any nesting depth; columns of the outermost record can always be
written by their plain name.  At the outermost level a ``Column`` is accepted
as well.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column

SEVERITIES = ("PASS", "WARN", "FAIL")
SET_MODES = ("all", "until_failed", "until_passes")

Formula = str | Column


def _tuple(items) -> tuple:
    return () if items is None else tuple(items)


@dataclass(frozen=True)
class SingleTest:
    """A condition with a severity and, if wanted, a replacement value."""

    field: str | None
    name: str | None
    condition: Formula | None
    if_false: str = "FAIL"
    substitute: Formula | None = None

    def __post_init__(self):
        severity = (self.if_false or "FAIL").upper()
        if severity not in SEVERITIES:
            raise ValueError(f"if_false must be one of {SEVERITIES}, not {self.if_false!r}")
        object.__setattr__(self, "if_false", severity)
        if self.name is None:
            object.__setattr__(self, "name", "Rule")
        if isinstance(self.substitute, str) and not self.substitute:
            object.__setattr__(self, "substitute", None)
        if self.substitute is not None and self.field is None:
            raise ValueError(f"test {self.name!r} has a substitute but no field to write it to")


@dataclass(frozen=True)
class TestSet:
    """Tests and sets run together: all, until one failed, or until one passes."""

    __test__ = False  # not a pytest class

    field: str | None
    name: str | None
    mode: str
    rules: tuple = ()

    def __post_init__(self):
        if self.mode not in SET_MODES:
            raise ValueError(f"mode must be one of {SET_MODES}, not {self.mode!r}")
        object.__setattr__(self, "rules", _tests_only(self.rules, "a test set"))


@dataclass(frozen=True)
class Generic:
    """Rules on the record as a whole, not tied to one of its fields."""

    rules: tuple = ()

    def __post_init__(self):
        object.__setattr__(self, "rules", _tests_only(self.rules, "generic rules"))


@dataclass(frozen=True)
class RecordOf:
    """Rules for the fields of a nested record."""

    field: str | None
    rules: tuple = ()

    def __post_init__(self):
        object.__setattr__(self, "rules", _tuple(self.rules))


@dataclass(frozen=True)
class ArrayOf:
    """Rules run once per array element.

    ``element`` and ``index`` name the lambda variables formulas may use; they
    default to ``e``/``i`` and, in an array within an array, ``e2``/``i2``.
    """

    field: str | None
    rules: tuple = ()
    element: str | None = None
    index: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "rules", _tuple(self.rules))


@dataclass(frozen=True)
class UnionOf:
    """One rule per type of a union held as ``struct<member0, member1, ...>``.

    A branch is a pair (member field, rule); the member ``None`` stands for the
    null type.
    """

    field: str | None
    branches: tuple = ()

    def __post_init__(self):
        branches = self.branches.items() if isinstance(self.branches, dict) else self.branches
        object.__setattr__(self, "branches", tuple((m, r) for m, r in branches or ()))


@dataclass(frozen=True)
class Step:
    name: str
    rules: tuple = ()

    def __post_init__(self):
        object.__setattr__(self, "rules", _tuple(self.rules))


@dataclass(frozen=True)
class RuleFile:
    name: str
    steps: tuple = ()
    input_subject: str | None = None
    output_subject: str | None = None
    schema: str | None = None
    sample_file: str | None = None
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "steps", _tuple(self.steps))

    @classmethod
    def of(cls, name: str, *rules, **kwargs) -> "RuleFile":
        """A file with a single step holding ``rules``."""
        return cls(name, (Step("step 1", rules),), **kwargs)

    def only_step(self, number: int) -> "RuleFile":
        return replace(self, steps=(self.steps[number],))


def _tests_only(rules: Iterable | None, where: str) -> tuple:
    rules = _tuple(rules)
    for rule in rules:
        if not isinstance(rule, (SingleTest, TestSet)):
            raise ValueError(f"{where} can hold tests and test sets, not {type(rule).__name__}")
    return rules
