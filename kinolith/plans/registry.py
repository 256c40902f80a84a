"""All queries of the package by name."""

from __future__ import annotations

from kinolith.plans import columns, curation, evaluation, intake, sequences, structures  # noqa: F401
from kinolith.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
