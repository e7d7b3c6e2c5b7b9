"""Operators for large-scale training data. Nothing else in the library imports this package."""

from loomspan.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
