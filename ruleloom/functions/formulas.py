"""Spark SQL text for formula constructs that have no one-to-one SQL spelling.

Each function takes and returns SQL text, so the results nest freely and can be
used at any depth of a rule.  String positions count from 0.
"""

from __future__ import annotations

from ..plans.sqltext import literal, quote

# White space of any script: the separators of Unicode but for the unbreakable ones, and the control characters that separate.
WHITE = (
    "".join(chr(92) + x for x in ("t", "n", "x0B", "f", "r", "x1C-" + chr(92) + "x1F"))
    + " \u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000"
)


def unused(name: str, *texts: str) -> str:
    """The name, longer where one of the texts holds it."""
    while any(name in text for text in texts):
        name += "_"
    return name


def bound(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` stands for ``value``: it is evaluated once, however often the name occurs and
    whatever the loops that it occurs in."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def same(a: str, b: str) -> str:
    """Equality that is never NULL: two NULLs are equal."""
    return f"({a} <=> {b})"


def differs(a: str, b: str) -> str:
    return f"(NOT ({a} <=> {b}))"


def conditional(test: str, then: str, otherwise: str) -> str:
    return f"(CASE WHEN {test} THEN {then} ELSE {otherwise} END)"


def first_given(*values: str) -> str:
    return f"coalesce({', '.join(values)})"


def empty(text: str) -> str:
    """NULL or zero length."""
    return f"({text} IS NULL OR length({text}) = 0)"


def empty_collection(value: str) -> str:
    return f"({value} IS NULL OR size({value}) = 0)"


def blank(text: str) -> str:
    """Empty, or white space of any script only; NULL for NULL."""
    return f"({text} RLIKE {literal(chr(92) + 'A[' + WHITE + ']*' + chr(92) + 'z')})"


def trim(text: str) -> str:
    """Without the characters up to U+0020 (blanks, tabs, line ends, control characters) at both ends."""
    ends = literal(f"{chr(92)}A[{chr(92)}x00- ]+|[{chr(92)}x00- ]+{chr(92)}z")
    return f"regexp_replace({text}, {ends}, '')"


def split(text: str, pattern: str) -> str:
    """Parts between the matches, without empty parts at the end; a text without a match is one part."""
    t, parts = unused("__text", pattern), unused("__parts", pattern)
    last = (
        f"aggregate({parts}, named_struct('n', 0, 'last', 0), (a, x) -> named_struct('n', a.n + 1, "
        f"'last', CASE WHEN x <> '' THEN a.n + 1 ELSE a.last END), a -> a.last)"
    )
    kept = bound(f"split({t}, {literal(pattern)})", parts, f"slice({parts}, 1, {last})")
    whole = f"NOT ({t} RLIKE {literal(pattern)})"
    return bound(text, t, f"CASE WHEN {whole} THEN array({t}) WHEN {t} IS NOT NULL THEN {kept} END")


def matches(text: str, pattern: str) -> str:
    """Whether the pattern matches the whole text."""
    anchored = chr(92) + f"A(?:{pattern})" + chr(92) + "z"  # $ would accept a line end behind the match
    return f"({text} RLIKE {literal(anchored)})"


def member(value: str, values: str) -> str:
    """Whether an array holds the value."""
    return f"array_contains({values}, {value})"


def index_of(text: str, part: str) -> str:
    """Position of the first occurrence, -1 if there is none."""
    return f"(locate({part}, {text}) - 1)"


def char_at(text: str, position: str) -> str:
    return f"substring({text}, ({position}) + 1, 1)"


def substring(text: str, begin: str, end: str | None = None) -> str:
    """From ``begin`` up to, not including, ``end``."""
    if end is None:
        return f"substring({text}, ({begin}) + 1)"
    return f"substring({text}, ({begin}) + 1, ({end}) - ({begin}))"


def equals_ignore_case(a: str, b: str) -> str:
    return f"(lower({a}) <=> lower({b}))"


def item(array: str, position: str) -> str:
    """The element, NULL if the array is NULL or too short; plain ``a[0]`` stops the job then."""
    return f"get({array}, {position})"


def find(array: str, field: str, value: str) -> str:
    """The first record of an array whose field has the value, else NULL."""
    wanted, found = unused("__wanted", array, field, value), unused("__found", array, field, value)
    return bound(value, wanted, f"get(filter({array}, {found} -> {found}.{quote(field)} = {wanted}), 0)")


def json_value(text: str, path: str, dtype: str = "STRING") -> str:
    """A value inside JSON text, NULL if it is missing or of another type."""
    return f"try_cast(get_json_object({text}, {literal(path)}) AS {dtype})"
