"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from lodestrata.plans import pipeline_queries, scalar_queries, search_queries, source_queries, structure_queries

MODULES = (scalar_queries, search_queries, structure_queries, source_queries, pipeline_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
