"""Queries and their SQL, by name."""

from __future__ import annotations

from lexspark.plans import book_queries, more_queries, record_queries, segment_queries, state_queries

QUERIES: dict = {**segment_queries.QUERIES, **record_queries.QUERIES, **book_queries.QUERIES, **more_queries.QUERIES, **state_queries.QUERIES}
ORACLES: dict[str, str] = {**segment_queries.ORACLES, **record_queries.ORACLES, **book_queries.ORACLES, **more_queries.ORACLES, **state_queries.ORACLES}
