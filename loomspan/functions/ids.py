"""Content-derived identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.text import trim_all
from loomspan.functions.urls import normalize_url


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def hex_id(c: Column, length: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def document_id(url: Column, content: Column | None = None, title: Column | None = None) -> Column:
    """``web-`` and 24 hex digits of the normalised URL, else of content, title, or the word document."""
    rest = [F.nullif(_or_empty(c), F.lit("")) for c in (content, title) if c is not None]
    return F.concat(F.lit("web-"), hex_id(F.coalesce(F.nullif(normalize_url(_or_empty(url)), F.lit("")), *rest, F.lit("document")), 24))


def content_hash(url: Column, title: Column, content: Column) -> Column:
    """SHA-256 of normalised URL, trimmed title and trimmed content with LF line ends."""
    body = trim_all(F.regexp_replace(_or_empty(content), r"\r\n?", "\n"))
    return F.sha2(F.concat(normalize_url(_or_empty(url)), F.lit("\n"), trim_all(_or_empty(title)), F.lit("\n"), body), 256)


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    return hex_id(F.concat(document, F.lit(":"), index.cast("string"), F.lit(":"), text), 24)


def edge_id(document: Column, source: Column, relation: Column, target: Column) -> Column:
    return hex_id(F.concat_ws(":", *[_or_empty(c) for c in (document, source, relation, target)]), 24)


def cache_key(scope: str, payload: Column) -> Column:
    return F.concat(F.lit(f"{scope}:"), F.sha2(payload, 256))
