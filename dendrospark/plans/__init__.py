"""Registered queries over the driver's tables and their SQL counterparts."""

from .catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
