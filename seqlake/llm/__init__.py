"""Operators for preparing training text: deduplication, scoring, filtering, mixing and sharding."""

from seqlake.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
