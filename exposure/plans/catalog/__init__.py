"""Registered queries and their SQL twins."""

from exposure.plans.catalog import (  # noqa: F401
    feeds, files, functions, ledgers, matching, notifications, replies, rollups, searches, streams, text,
)
from exposure.plans.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
