"""All registered queries."""

from __future__ import annotations

from . import catalog_queries, profile_queries, result_queries, storage_queries, target_queries
from .registered import REGISTERED, Query

__all__ = ["queries", "oracle_sql", "flagship"]

flagship = catalog_queries.vetted_orders
_MODULES = (profile_queries, target_queries, result_queries, catalog_queries, storage_queries)


def queries() -> dict[str, Query]:
    """Name to Spark function."""
    return {name: entry.run for name, entry in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    """Name to the SQL that gives the same rows, where there is one."""
    return {name: entry.sql for name, entry in REGISTERED.items() if entry.sql is not None}
