"""The queries the repository registers, with equivalent SQL where there is one."""

from . import arrays, audits, cleansing, flows, formulas, reporting, sets, singles, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
