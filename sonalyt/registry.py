"""The library's queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from .plans import checks, deadlines, entities, recordings, records, reports, selection, slots, sources, texts, timings  # noqa: F401  register their queries
from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "lane_summary"
