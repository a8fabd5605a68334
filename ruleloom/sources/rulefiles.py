"""Reading rule files and job settings (JSON) on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from ..model import ArrayOf, Generic, RecordOf, RuleFile, SingleTest, Step, TestSet, UnionOf

# Fixed values of the file format: the "type" names of test sets and their modes.
SET_TYPES = {
    "TestSetAll": "all",
    "TestSetFirstFail": "until_failed",
    "TestSetFirstPass": "until_passes",
}


def parse_rule_file(text: str, name: str | None = None) -> RuleFile:
    """A rule file from its JSON text.

    Unknown keys are ignored, a missing or null list counts as empty and rules
    without a test (empty rules) are dropped.
    """
    data = json.loads(text)
    steps = tuple(Step(s.get("fieldname") or "step", _rules(s)) for s in data.get("rulesteps") or ())
    return RuleFile(
        name=name or data.get("name") or "new",
        steps=steps,
        input_subject=data.get("inputsubjectname"),
        output_subject=data.get("outputsubjectname"),
        schema=data.get("schema"),
        sample_file=data.get("samplefile"),
    )


def load_rule_file(root: str | Path, subject: str, name: str, active: bool = True) -> RuleFile | None:
    """``<root>/<subject>/active|inactive/<name>``, None if there is no such file."""
    if PurePosixPath(name).is_absolute():
        raise ValueError(f"rule file name {name!r} must be a relative path")
    path = Path(root) / subject / ("active" if active else "inactive") / name
    if not path.is_file():
        return None
    found = parse_rule_file(path.read_text(encoding="utf-8"), name)
    return RuleFile(name, found.steps, subject, found.output_subject, found.schema, found.sample_file)


def sample_values(text: str, step: int = 0) -> dict:
    """The sample inputs kept in one step of a rule file, nested like the record."""
    return _sample({**json.loads(text)["rulesteps"][step], "type": "RecordRule"})


def _sample(node: dict):
    kind, children = node.get("type"), node.get("rules") or ()
    if kind == "RecordRule":
        return {c["fieldname"]: _sample(c) for c in children if c.get("fieldname") and c.get("type") != "GenericRules"}
    if kind == "ArrayRule":
        first = _sample(children[0]) if children else None
        return [] if first is None else [first]
    if kind == "UnionRule":
        members = [c for c in children if (c.get("fielddatatype") or "").upper() != "NULL"]
        given = ((n, c) for n, c in enumerate(members) if c.get("sampleinput") is not None)
        return next(({f"member{n}": _sample(c)} for n, c in given), None)
    return node.get("sampleinput")


def _rules(node: dict) -> tuple:
    return tuple(r for r in map(_rule, node.get("rules") or ()) if r is not None)


def _rule(node: dict):
    kind, field, name = node.get("type"), node.get("fieldname"), node.get("rulename")
    if kind == "EmptyRule":
        return None
    if kind == "PrimitiveRule":
        return SingleTest(field, name, node.get("condition"), node.get("iffalse") or "FAIL", node.get("substitute"))
    if kind in SET_TYPES:
        return TestSet(field, name, SET_TYPES[kind], _rules(node))
    if kind == "GenericRules":
        return Generic(_rules(node))
    if kind == "RecordRule":
        return RecordOf(field, _rules(node))
    if kind == "ArrayRule":
        # the rule of a record element carries the name of the array; the element itself is meant
        inner = (RecordOf(None, r.rules) if isinstance(r, RecordOf) else r for r in _rules(node))
        return ArrayOf(field, tuple(inner), node.get("elementname"), node.get("indexname"))
    if kind == "UnionRule":
        return UnionOf(field, tuple(_branches(node)))
    raise ValueError(f"unknown rule type {kind!r}")


def _branches(node: dict):
    """Branches in order; the null type has no member, the others count from member0."""
    position = 0
    for child in node.get("rules") or ():
        if (child.get("fielddatatype") or "").upper() == "NULL":
            member = None
        else:
            member, position = f"member{position}", position + 1
        rule = _rule(child)
        if isinstance(rule, (RecordOf, ArrayOf)):
            # already at the member: nothing further to step into
            rule = type(rule)(**{**rule.__dict__, "field": None})
        if rule is not None:
            yield child.get("member", member), rule


@dataclass(frozen=True)
class TopicRule:
    """One validation job: where records come from, where they go, which rules apply."""

    input_topic: str
    output_topic: str
    rule_files: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "rule_files", tuple(self.rule_files or ()))
        if not self.input_topic or not self.output_topic:
            raise ValueError("a topic rule needs an input and an output topic")
        if self.input_topic == self.output_topic:
            raise ValueError(f"input and output topic are both {self.input_topic!r}")

    @property
    def consumer_group(self) -> str:
        return f"rules_{self.input_topic}"

    @classmethod
    def parse(cls, text: str) -> "TopicRule":
        data = json.loads(text)
        return cls(data.get("inputtopicname"), data.get("outputtopicname"), data.get("rulefiles"))

    def load(self, root: str | Path) -> list[RuleFile]:
        """The active versions of the rule files, named ``<subject>/<file>``; those that are not active are left out.

        A job none of whose rule files is active is refused.
        """
        found = []
        for key in self.rule_files:
            subject, slash, name = key.partition("/")
            if not slash or not subject:
                raise ValueError(f"rule file {key!r} is not of the form <subject>/<filename>")
            rules = load_rule_file(root, subject, name)
            if rules is not None:
                found.append(rules)
        if self.rule_files and not found:
            raise FileNotFoundError(f"none of the rule files {list(self.rule_files)} is active")
        return found
