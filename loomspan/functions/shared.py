"""Tables written to the folder that all executors share, to cut lineage and to reuse a result."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset (tests, one machine), a new local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='loomspan-')}"
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


_LIVE: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 the session may be over
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, deleted by :func:`release` or when the interpreter ends."""
    path = f"{shared_dir(spark)}/loomspan-{name}-{uuid.uuid4().hex}"
    _LIVE[path] = spark
    return path


def release() -> None:
    """Deletes what :func:`written` and :func:`scratch` have made so far. Call it when their readers are done."""
    while _LIVE:
        path, spark = _LIVE.popitem()
        _delete(spark, path)


atexit.register(release)


def written(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: they survive the loss of executors.

    ``by``: a column of few values; a filter on one of them then reads its files only.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
