"""The queries of the engine, and SQL that gives the same rows."""

from __future__ import annotations

from loomrow.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "most_reads_node"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
