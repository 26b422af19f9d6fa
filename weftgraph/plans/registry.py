"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from weftgraph.plans import graph_queries, problems

FLAGSHIP = "ck_metrics_lifted"
QUERIES = {**problems.QUERIES, **graph_queries.QUERIES}
ORACLE = {**problems.ORACLE, **graph_queries.ORACLE}
