"""What the plans share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.merging import latest_by

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries by name, and the SQL of those that have it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def put(self, name: str, query: Query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.sql[name] = sql

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self.put(query.__name__, query, sql)
            return query

        return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_in(words: Iterable[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def newest_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The newest row of each document."""
    rows = table(spark, sf, "corpus").where("document_id IS NOT NULL")
    return latest_by(rows, ["document_id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("crawl_batch_id"), F.desc_nulls_last("content_hash")])
