"""Data-quality rules as Spark column expressions."""

from .model import ArrayOf, Generic, RecordOf, RuleFile, SingleTest, Step, TestSet, UnionOf
from .plans.engine import validate

__all__ = ["ArrayOf", "Generic", "RecordOf", "RuleFile", "SingleTest", "Step", "TestSet", "UnionOf", "validate"]
