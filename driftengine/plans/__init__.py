"""Queries over the test tables, one or more per operator, with SQL counterparts."""

from driftengine.plans import models, sequences, stats, tables  # noqa: F401
from driftengine.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
