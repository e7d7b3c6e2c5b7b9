"""Structured Streaming: idempotent ingestion, windows over late events, expiring state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.operators.merging import latest_by
from loomspan.sources.versions import Versions


def read_folder(spark: SparkSession, folder: str, schema: str, files: int = 1000, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(folder)


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Micro-batches of what is there now, each handed to ``each``; the checkpoint makes restarts go on where it was."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(folder: str, keys: list[str], order: list[str], most_parts: int = 16) -> Callable[[DataFrame, int], None]:
    """A sink for the newest row of each key, which :func:`latest` reads: a micro-batch, reduced to one row a key, is
    appended as a part of a versioned table, so what it writes doesn't grow with the table; beyond ``most_parts`` the
    parts are merged into one, and old ones deleted. A batch that is run again changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        held = Versions(batch.sparkSession, folder)
        if held.values.get("batch", -1) >= number:
            return
        newest = [F.desc(c) for c in order]
        if len(held.parts("rows")) < most_parts:
            held.put("rows", latest_by(batch, keys, newest))
        else:
            held.put("rows", latest_by(held.table("rows").unionByName(batch), keys, newest), replace=True)
        held.commit(batch=number)

    return each


def latest(spark: SparkSession, folder: str, keys: list[str], order: list[str]) -> DataFrame | None:
    """The newest row of each key that a :func:`keep_latest` sink holds; None before its first batch."""
    held = Versions(spark, folder).table("rows")
    return None if held is None else latest_by(held, keys, [F.desc(c) for c in order])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event counts and sums by window and type; events later than the watermark are dropped."""
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def lru_replay(log: DataFrame, capacity: int, ttl_seconds: float) -> DataFrame:
    """Hits, misses, sets and evictions of a cache per scope, from an access log (scope, at, key).

    An entry expires ``ttl_seconds`` after it was set; reading renews its rank, not its time. Beyond ``capacity``
    the entry used longest ago goes. State is one scope's cache of at most ``capacity`` keys; log rows are
    streamed in order, so a hot scope needs no more memory than any other.
    """
    ordered = log.select("scope", F.col("at").cast("double").alias("at"), "key").repartition("scope").sortWithinPartitions("scope", "at", "key")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, cache, n = None, {}, dict.fromkeys(("hits", "misses", "sets", "evictions"), 0)

        def row() -> pd.DataFrame:
            return pd.DataFrame([{"scope": scope, **n, "size": len(cache)}])

        for part in parts:
            for s, at, key in part.itertuples(index=False):
                if s != scope:
                    if scope is not None:
                        yield row()
                    scope, cache, n = s, {}, dict.fromkeys(n, 0)
                set_at = cache.pop(key, None)
                if set_at is not None and at - set_at <= ttl_seconds:
                    n["hits"] += 1
                    cache[key] = set_at
                    continue
                n["evictions"] += set_at is not None
                n["misses"] += 1
                n["sets"] += 1
                cache[key] = at
                if len(cache) > capacity:
                    del cache[next(iter(cache))]
                    n["evictions"] += 1
        if scope is not None:
            yield row()

    return ordered.mapInPandas(run, "scope string, hits bigint, misses bigint, sets bigint, evictions bigint, size bigint")


def folded_answers(lines: DataFrame, key: str = "message_id", order: str = "seq") -> DataFrame:
    """(``key``, text, n_texts, done) of answers that came as JSON events, one a line: metadata, any number of text, done.

    ``lines``: ``key``, ``order``, value. Texts are joined in order. Lines that can't be read, and kinds that aren't known,
    are passed over; an answer without a done event isn't done.
    """
    event = F.from_json("value", "struct<type:string,text:string>")
    e = lines.select(key, F.col(order).alias("o"), event.alias("e")).where(F.col("e.type").isin("metadata", "text", "done"))
    texts = F.collect_list(F.when(F.col("e.type") == "text", F.struct("o", F.coalesce("e.text", F.lit("")).alias("t"))))
    out = e.groupBy(key).agg(F.array_sort(texts).alias("x"), F.bool_or(F.col("e.type") == "done").alias("done"))
    return out.select(key, F.array_join(F.col("x.t"), "").alias("text"), F.size("x").cast("long").alias("n_texts"), "done")
