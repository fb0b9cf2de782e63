"""All queries of the engine with their SQL."""

from __future__ import annotations

from .plans import graph_queries, retrieval_queries, rule_queries, text_queries

_PARTS = (retrieval_queries, text_queries, rule_queries, graph_queries)


def queries() -> dict:
    return {k: v[0] for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for part in _PARTS for k, v in part.QUERIES.items() if v[1]}
