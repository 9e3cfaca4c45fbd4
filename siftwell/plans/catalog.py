"""All registered queries of the library itself, and the SQL that checks them."""

from __future__ import annotations

from . import q_graph, q_jobs, q_knowledge, q_search, q_tables, q_text  # noqa: F401  (they register their queries)
from .q_search import flagship
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]
