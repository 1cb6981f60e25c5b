"""All registered queries and their SQL."""

from __future__ import annotations

from litmine.plans import graph_queries, mention_queries, source_queries, text_queries

_MODULES = (mention_queries, graph_queries, text_queries, source_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
