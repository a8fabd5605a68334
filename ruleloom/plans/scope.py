"""Where a rule stands in a nested record, and how names resolve from there."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from .sqltext import literal, quote

_REFERENCE = re.compile(r"\{([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\}")


@dataclass(frozen=True)
class Place:
    """A value inside the record: how SQL reads it, its type and its path.

    ``path`` holds SQL text pieces which, concatenated, spell the path of the
    value, e.g. ``addresses[0].city``; it is empty for the outermost record.
    ``id`` tells places apart whatever their lambda variables are called.
    """

    ref: str
    dtype: T.DataType
    path: tuple[str, ...] = ()
    parent: "Place | None" = None
    id: str = ""

    @property
    def is_root(self) -> bool:
        return self.parent is None

    def names(self) -> list[str]:
        return self.dtype.fieldNames() if isinstance(self.dtype, T.StructType) else []

    def read(self, name: str) -> str:
        return quote(name) if self.is_root else f"{self.ref}.{quote(name)}"

    def child(self, name: str) -> "Place":
        if name not in self.names():
            raise ValueError(f"no field {name!r} in {self.describe()}; it has {self.names()}")
        return Place(self.read(name), self.dtype[name].dataType, self._extend(name), self, f"{self.id}.{name}")

    def member(self, name: str) -> "Place":
        """A union member: read like a field, but with the path of the union itself."""
        if name not in self.names():
            raise ValueError(f"no union member {name!r} in {self.describe()}; it has {self.names()}")
        return Place(self.read(name), self.dtype[name].dataType, self.path, self.parent, f"{self.id}.{name}")

    def element(self, element: str, index: str) -> "Place":
        path = self.path + (literal("["), f"CAST({index} AS STRING)", literal("]"))
        return Place(element, self.dtype.elementType, path, self, self.id + "[]")

    def _extend(self, name: str) -> tuple[str, ...]:
        return self.path + (literal("." + name),) if self.path else (literal(name),)

    def describe(self) -> str:
        return "the record" if self.is_root else self.ref

    def path_of(self, field: str | None) -> tuple[str, ...]:
        return self.path if field is None else self._extend(field)

    def bind(self, formula: str) -> str:
        """Replace every ``{name}`` and ``{parent.name}`` by what SQL calls it here."""

        def resolve(match: re.Match) -> str:
            here, names = self, match.group(1).split(".")
            while names and names[0] == "parent":
                here = here.parent
                names = names[1:]
                if here is None:
                    raise ValueError(f"{match.group(0)} leaves the record in formula: {formula}")
            if not names:
                if here.is_root:
                    raise ValueError(f"{match.group(0)} names the whole record in formula: {formula}")
                return here.ref
            if here.names() and names[0] not in here.names():
                raise ValueError(f"{match.group(0)} is not a field in formula: {formula}")
            return ".".join([here.read(names[0]), *map(quote, names[1:])])

        return _REFERENCE.sub(resolve, formula)


def path_sql(pieces: tuple[str, ...]) -> str:
    if not pieces:
        return "CAST(NULL AS STRING)"
    return pieces[0] if len(pieces) == 1 else "concat(" + ", ".join(pieces) + ")"


def is_static(pieces: tuple[str, ...]) -> bool:
    return all(p.startswith("'") for p in pieces)


def root_place(schema: T.StructType) -> Place:
    return Place("", schema)
