"""All registered queries of the log engine, by name."""

from __future__ import annotations

from . import document_queries, events_queries, recipe_queries, search_queries, summary_queries

MODULES = (events_queries, summary_queries, search_queries, document_queries, recipe_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
