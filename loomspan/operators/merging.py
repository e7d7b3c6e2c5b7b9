"""Versioned tables: latest rows, keyed upserts, retiring of stale children, staged batch merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in ``order``. Spark limits each group before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, staged: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Target with the staged rows put in: a staged row replaces its key's row, but for the columns in ``keep``.

    Both sides have one row a key. Rows with a null key never match and stay.
    """
    t, s = target.alias("t"), staged.select(*target.columns).alias("s")
    both = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    staged_row = F.col(f"s.{key}").isNotNull()

    def pick(c: str) -> Column:
        new = F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")) if c in keep else F.col(f"s.{c}")
        return F.when(staged_row, new).otherwise(F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}"))).alias(c)

    return both.select(*[pick(c) for c in target.columns])


def retire_stale(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Children less those of a staged document whose hash is not the staged one (a null hash is not).

    ``documents``: document_id, content_hash, one row a document. One hash join; nothing is collected.
    """
    d = documents.select(F.col("document_id").alias("_d"), F.col("content_hash").alias("_h"))
    joined = children.join(d, F.col("document_id") == F.col("_d"), "left")
    return joined.where(F.col("_d").isNull() | F.coalesce(F.col("content_hash") == F.col("_h"), F.lit(False))).drop("_d", "_h")


def staged_merge(tables: dict[str, DataFrame], staged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New versions of corpus, chunks and graph_edges after a batch: the latest staged row of each key is put
    in (documents keep created_at), and children of older versions of the staged documents go.

    Merging the same batch twice changes nothing.
    """
    docs = latest_by(staged["corpus"], ["document_id"], [F.desc("updated_at"), F.desc("content_hash")])
    out = {"corpus": upsert(tables["corpus"], docs, "document_id", keep=("created_at",))}
    for name, key in (("chunks", "chunk_id"), ("graph_edges", "edge_id")):
        rows = latest_by(staged[name], [key], [F.desc("created_at"), F.desc("content_hash")])
        out[name] = retire_stale(upsert(tables[name], rows, key), docs)
    return out


def skip_unchanged(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """``status`` of each candidate (document_id, content_hash): SKIPPED_UNCHANGED where the stored hash is the same."""
    known = existing.groupBy("document_id").agg(F.max_by("content_hash", "updated_at").alias("_h"))
    joined = candidates.join(known, "document_id", "left")
    return joined.withColumn("status", F.when(F.col("_h") == F.col("content_hash"), "SKIPPED_UNCHANGED").when(F.col("_h").isNull(), "NEW").otherwise("CHANGED")).drop("_h")


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't there yet, each once: an append that can be repeated. Null keys equal each other."""
    held = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.dropDuplicates(keys).join(held, same, "left_anti")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
