"""Whole jobs: the migration run and the registered queries."""

from typeloom.plans import catalogs, edits, relational, sinks, typed, values
from typeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogs", "edits", "relational", "sinks", "typed", "values"]
