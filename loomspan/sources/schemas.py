"""Schemas of the store's tables; reading with them drops unknown fields and adds missing ones as nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "corpus": "document_id string, source_url string, title string, source_name string, category string, crawler string, gcs_uri string, content_hash string, crawl_batch_id string, content string, metadata_json string, created_at timestamp, updated_at timestamp",
    "chunks": "chunk_id string, document_id string, source_url string, title string, chunk_index bigint, content string, embedding array<double>, content_hash string, crawl_batch_id string, metadata_json string, created_at timestamp",
    "graph_edges": "edge_id string, document_id string, source_url string, source_id string, source_label string, source_type string, source_description string, target_id string, target_label string, target_type string, target_description string, relation string, content_hash string, crawl_batch_id string, metadata_json string, created_at timestamp",
    "crawl_runs": "event_id string, run_id string, source_id bigint, source_name string, url string, title string, status string, log string, display_time string, pages_count bigint, chunks_count bigint, nodes_count bigint, links_count bigint, crawler string, gcs_status string, bigquery_status string, knowledge_catalog_status string, created_at timestamp, updated_at timestamp",
    "crawl_attempts": "run_id string, source_id bigint, source_name string, url string, normalized_url string, document_id string, content_hash string, status string, error string, gcs_uri string, crawler string, created_at timestamp, updated_at timestamp",
    "response_feedback": "event_id string, message_id string, response_id string, rating string, prompt string, response string, citations_json string, user_agent string, created_at timestamp",
}
KEYS = {"corpus": "document_id", "chunks": "chunk_id", "graph_edges": "edge_id"}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of the table in order and type; missing ones are null, further ones dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])
