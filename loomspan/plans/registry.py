"""All queries over the project's tables, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.plans import knowledge, service, store

_ALL = (knowledge.plans, store.plans, service.plans)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.hybrid(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for p in _ALL for name, q in p.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for p in _ALL for name, s in p.sql.items()}
