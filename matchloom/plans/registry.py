"""All registered queries and their SQL, outside of the subpackage llm."""

from __future__ import annotations

from collections.abc import Callable

from matchloom.plans import analytics_queries, data_oracles, data_problems, io_queries, relational_queries

_GROUPS = (relational_queries.query, analytics_queries.query, io_queries.query)


def queries() -> dict[str, Callable]:
    out = dict(data_problems.QUERIES)
    for g in _GROUPS:
        out |= g.queries
    return out


def oracles() -> dict[str, str]:
    out = dict(data_oracles.oracles())
    for g in _GROUPS:
        out |= g.sql
    return out
