"""Queries of the listings engine: `queries()` and `oracle_sql()`, in the form __spark_entry__.py collects."""

from __future__ import annotations

from listwright.plans import catalog, discovery_queries, matching_queries, report_queries, state_queries  # noqa: F401
from listwright.plans.catalog import Query


def queries() -> dict[str, Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
