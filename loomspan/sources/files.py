"""Readers and writers: typed JSON lines, shards, feedback logs, metadata documents, parquet stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.functions.shared import written
from loomspan.sources.schemas import schema

SHARD_ROWS = 5000
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # the default format ends at milliseconds


def read_jsonl(spark: SparkSession, name: str, paths: list[str]) -> DataFrame:
    """JSON lines in the table's schema; unknown fields are dropped, no paths give an empty table."""
    if not paths:
        return spark.createDataFrame([], schema(name))
    return spark.read.schema(schema(name)).option("mode", "DROPMALFORMED").option("timestampFormat", _STAMP).json(paths)


def read_shards(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """All ``<name>-*.jsonl`` files of a folder."""
    return spark.read.schema(schema(name)).option("pathGlobFilter", f"{name}-*.jsonl").option("timestampFormat", _STAMP).json(folder)


def write_shards(df: DataFrame, folder: str, rows: int = SHARD_ROWS) -> None:
    """JSON lines in files of at most ``rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("timestampFormat", _STAMP).json(folder)


def shard_numbers(df: DataFrame, order: list[str], rows: int = SHARD_ROWS) -> DataFrame:
    """``shard`` of each row in a total order: every ``rows`` rows a new one.

    Row numbers come from range-partitioned counts, so no single task sees all rows.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    placed = written(placed, "placed")  # ranges are sampled: they must not be drawn anew for the counts
    sizes = placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("_p", "first", "before")
    out = placed.join(F.broadcast(starts), "_p").withColumn("shard", F.floor((F.col("_i") - F.col("first") + F.col("before")) / rows).cast("long"))
    return out.drop("_p", "_i", "first", "before")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """A feedback log of JSON lines: blank and broken lines are dropped."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.from_json(F.trim("value"), schema("response_feedback")).alias("r"), F.col("value"))
    return parsed.where(F.col("r").isNotNull() & F.col("r.event_id").isNotNull()).select("r.*")


def metadata_document(title: Column, url: Column, source: Column, links: Column, most: int = 50) -> Column:
    """A front-matter document of one row: quoted fields and its first links."""
    rows = F.transform(F.slice(links, 1, most), lambda x: F.concat(F.lit("  - "), text.yaml_string(x)))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), text.yaml_string(title)), F.concat(F.lit("url: "), text.yaml_string(url)), F.concat(F.lit("source: "), text.yaml_string(source)))
    return F.concat_ws("\n", head, F.lit("links:"), F.array_join(rows, "\n"), F.lit("---"))


def write_snapshots(df: DataFrame, folder: str, key: str = "document_id", version: str = "content_hash", body: str = "content") -> None:
    """Raw texts under ``folder``, a directory for each prefix of the key's hash; a row is named by key and version, so that the
    versions of a document stand side by side. Rows without text or key have none."""
    rows = df.where(F.col(body).isNotNull() & F.col(key).isNotNull()).select(F.substring(F.sha2(key, 256), 1, 2).alias("prefix"), F.concat_ws("/", key, F.concat(F.coalesce(version, F.lit("none")), F.lit(".md"))).alias("name"), F.col(body).alias("body"))
    rows.dropDuplicates(["name"]).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(folder)


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(name, body) of the snapshots."""
    return spark.read.schema("prefix string, name string, body string").parquet(folder).select("name", "body")


def write_manifest(candidates: DataFrame, folder: str) -> None:
    """A discovery manifest: one JSON line a candidate (source_id, url), sorted by URL within each file."""
    candidates.select("source_id", "url").distinct().sortWithinPartitions("url").write.mode("overwrite").json(folder)
