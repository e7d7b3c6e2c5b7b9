"""Helpers on the physical layout of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.shared import written

_NARROW = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "DataSourceV2ScanRelation", "LogicalRDD", "LocalRelation"}
#: Scans of more bytes than this are never shuffled to spread them.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Rows of a small scan spread over the cores when it has fewer partitions than there are cores.

    Small inputs in one file would otherwise run a Python stage in a single task. A scan of more than
    SPREAD_BYTES is returned as it is, without a shuffle; so is anything but a filtered scan, because
    its partitions can't be counted without running it.
    """
    plan = node = df._jdf.queryExecution().optimizedPlan()
    while True:
        if node.getClass().getSimpleName() not in _NARROW:
            return df
        if not node.children().size():
            break
        node = node.children().apply(0)
    if int(str(plan.stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core)


def row_hashes(*columns: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of some columns; unlike a plain hash they tell nulls at different places apart."""
    told = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(*told), F.xxhash64(F.lit(7), *told)


def once(df: DataFrame) -> DataFrame:
    """Each whole row once, as ``distinct`` gives it, without a shuffle of the rows.

    Only 128-bit hashes of the rows are grouped; rows that have no copy pass a join with the few hashes that occur
    several times (they are written first; Spark sends them to all tasks only if they are below its broadcast
    threshold), and only rows with copies are gathered. Worth it for rows that hold texts. Columns must be
    hashable (no maps).
    """
    h1, h2 = row_hashes(*(F.col(f"`{c}`") for c in df.columns))
    several = df.select(h1.alias("_h1"), h2.alias("_h2")).groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    several = written(several, "copies")  # its size is known when the joins are planned
    tagged = spread(df).withColumns({"_h1": h1, "_h2": h2})
    single = tagged.join(several, ["_h1", "_h2"], "left_anti")
    copies = tagged.join(several, ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"])
    return single.unionByName(copies).drop("_h1", "_h2")


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A side of a join that goes to all tasks, after a check that it has at most ``most`` rows; else a ValueError."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to be taken to all tasks")
    return F.broadcast(df)
