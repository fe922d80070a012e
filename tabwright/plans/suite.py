"""All registered queries."""

from __future__ import annotations

from tabwright.plans import chart_queries, report_queries, source_queries, transform_queries  # noqa: F401  (they register on import)
from tabwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
