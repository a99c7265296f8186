"""All registered queries of the reference operators, and their SQL."""

from __future__ import annotations

from corpusloom.operators import chunk_queries, curation, event_queries, html_blocks, index_queries, relational_queries, retrieval, scalar_queries, topics  # noqa: F401
from corpusloom.operators.registry import ORACLES, QUERIES
from corpusloom.sources import queries as source_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
