"""All named queries with the SQL that each is compared with."""

from __future__ import annotations

from narrascope.plans import graph_queries, learning_queries, table_queries, text_queries  # noqa: F401  they register themselves
from narrascope.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
