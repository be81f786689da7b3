"""All queries of the engine and their SQL twins."""

from __future__ import annotations

from weftgraph.queries import analytics, constraints, detect, evaluate, extras, functions, governance, memory, resolve, retrieval, shapes, sources  # noqa: F401
from weftgraph.registry import OPERATORS, ORACLE_SQL, QUERIES

__all__ = ["OPERATORS", "ORACLE_SQL", "QUERIES"]
