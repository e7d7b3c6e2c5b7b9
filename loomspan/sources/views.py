"""The store's tables as temporary views, for ``spark.sql``; and a batch data source of crawled pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomspan.sources.schemas import TABLES, conform


def register(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[str]:
    """Creates or replaces a view for each table that the folder has, in the declared schema; returns their names."""
    made = []
    for name in names or list(TABLES):
        path = f"{folder}/{name}.parquet"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            conform(spark.read.parquet(path), name).createOrReplaceTempView(name)
            made.append(name)
    return made


class _Payloads(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            payload = json.load(f)
        for d in payload.get("documents") or []:
            depth = d.get("depth")
            yield d.get("url"), d.get("title"), d.get("content"), int(depth) if str(depth).lstrip("-").isdigit() else 0, d.get("status_code"), None
        for e in payload.get("errors") or []:
            yield e.get("url"), None, None, 0, None, e.get("error")


class CrawlPayloads(DataSource):
    """``spark.dataSource.register(CrawlPayloads)``, then ``spark.read.format("crawl_payloads").option("paths", "a.json,b.json")``:
    documents and errors of crawler payloads, one partition a file. The files lie where all executors can read them."""

    @classmethod
    def name(cls) -> str:
        return "crawl_payloads"

    def schema(self) -> str:
        return "url string, title string, content string, depth int, status_code int, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Payloads([p for p in self.options.get("paths", "").split(",") if p])
