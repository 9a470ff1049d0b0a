"""All core queries and their oracles, keyed by name."""

from __future__ import annotations

from docframe.plans import link_queries, package_queries, problems, text_queries

QUERIES = {**text_queries.QUERIES, **link_queries.QUERIES, **package_queries.QUERIES, **problems.QUERIES}
ORACLES = {**text_queries.ORACLES, **link_queries.ORACLES, **package_queries.ORACLES, **problems.ORACLES}
