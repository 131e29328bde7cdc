"""All registered queries of the library proper and their ANSI SQL twins."""

from __future__ import annotations

from lexloom.plans import check_queries, graph_queries, index_queries, provision_queries, text_queries, time_queries
from lexloom.plans.registry import Query

_REGISTRIES = (graph_queries.reg, text_queries.reg, provision_queries.reg, index_queries.reg, time_queries.reg, check_queries.reg)


def queries() -> dict[str, Query]:
    return {k: v for r in _REGISTRIES for k, v in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in _REGISTRIES for k, v in r.sql.items()}
