"""All queries by name, with the SQL that states the same rows."""

from __future__ import annotations

from lexmill.plans import corpus, drift, duplicates, evaluation, experiments, models, records, relational, vectors  # noqa: F401  they register
from lexmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
