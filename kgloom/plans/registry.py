"""Queries over the driver's tables, by name, with their SQL."""

from __future__ import annotations

import kgloom.plans.source_queries  # noqa: F401  (adds its queries)
from kgloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
