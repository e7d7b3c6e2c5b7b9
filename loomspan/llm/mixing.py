"""Problem 8: mixing sources to target weights, by Efraimidis-Spirakis keys and prefix sums."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.partitions import spread

TOKENIZER = os.environ.get("LOOMSPAN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Key buckets for each doubling of a key. Whatever the weights' scale, a bucket holds at most about
#: ln 2 / (e * OCTAVE) of a source, 0.1 %. Only the one in which the budget ends is sorted.
OCTAVE = 256
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, keep: list[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` and n_tokens. Null and empty texts have 0 tokens; texts are counted whole."""
    picked = spread(df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t")))
    kept = [f"k{i}" for i in range(len(keep))]
    schema = picked.select(*kept, F.lit(0).cast("long").alias("n_tokens")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    return picked.mapInArrow(count, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")


def es_key(doc_id: Column, weight: Column, seed: int = 42) -> Column:
    """-ln(u) / w with u in (0, 1) from the id: smaller comes first; null or non-positive weights come last."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-9))


def letter_share(text: Column) -> Column:
    """A weight for want of a better one: the share of letters among a text's characters, 0 for null and empty texts."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))


def plan_mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per listed source: what it has, what it should give, its whole epochs and what is left for a last, partial one.

    ``sizes``: source, n_tokens of each document. ``targets``: source, target_share, max_repeats; a target
    listed twice counts once. ``total_tokens``: size of the mix, by default that of all documents of the
    listed sources, each once. ``reachable`` is false if max_repeats of everything stays below the target.
    """
    want = F.broadcast(targets.where(F.col("source").isNotNull()).dropDuplicates(["source"]).select("source", "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("long").alias("max_repeats")))
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("n_docs"))
    plan = want.join(have, "source", "left").na.fill(0, ["source_tokens", "n_docs"])
    every = Window.partitionBy()  # one row a listed source: a table as small as targets
    total = F.sum("source_tokens").over(every) if total_tokens is None else F.lit(total_tokens)
    plan = plan.withColumn("total_tokens", total).withColumn("target_tokens", F.col("target_share") * F.col("total_tokens"))
    plan = plan.withColumn("reachable", F.col("max_repeats") * F.col("source_tokens") >= F.col("target_tokens"))
    epochs = F.when(F.col("source_tokens") > 0, F.least(F.floor(F.col("target_tokens") / F.col("source_tokens")), F.col("max_repeats"))).otherwise(F.lit(0))
    plan = plan.withColumn("full_epochs", epochs.cast("long"))
    rest = F.when(F.col("full_epochs") < F.col("max_repeats"), F.col("target_tokens") - F.col("full_epochs") * F.col("source_tokens")).otherwise(F.lit(0.0))
    return plan.withColumn("rest_tokens", rest)


def draw_mix(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the documents in the mix.

    ``sizes``: doc_id, source, n_tokens, weight. Each document comes ``full_epochs`` times; those with the
    smallest keys whose token prefix sum stays within ``rest_tokens`` come once more. The prefix sums are made
    of sums by key bucket first; rows are sorted only in the one bucket of a source in which its budget ends,
    so no task sorts a whole source, however large. ``sizes`` is read three times: write it first.
    """
    keyed = sizes.select("doc_id", "source", "n_tokens", es_key(F.col("doc_id"), F.col("weight")).alias("key"))
    keyed = keyed.withColumn("bucket", F.floor(F.log2("key") * OCTAVE).cast("int"))
    by_bucket = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = plan.select("source", "full_epochs", "rest_tokens")
    cut = by_bucket.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(F.broadcast(ends), "source")
    cut = cut.where((F.col("before") <= F.col("rest_tokens")) & (F.col("before") + F.col("n") > F.col("rest_tokens"))).groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("cut"))
    ends = F.broadcast(ends.join(cut, "source", "left").select("source", "full_epochs", "rest_tokens", F.col("cut.bucket").alias("cut_bucket"), F.col("cut.before").alias("before")))
    rows = keyed.join(ends, "source")
    inside = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where(F.col("bucket") == F.col("cut_bucket")).withColumn("more", (F.col("before") + F.sum("n_tokens").over(inside) <= F.col("rest_tokens")).cast("long"))
    rest = rows.where(F.col("cut_bucket").isNull() | (F.col("bucket") != F.col("cut_bucket"))).withColumn("more", (F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket"))).cast("long") * (F.col("rest_tokens") > 0).cast("long"))
    return edge.unionByName(rest).withColumn("repeats", F.col("full_epochs") + F.col("more")).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def report_shares(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual share of every listed source; a source without documents has share 0.

    ``spent``: whether every document of the source was drawn as often as it may be.
    """
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"), F.min("repeats").alias("least_repeats"), F.count("*").alias("n_drawn"))
    out = plan.join(got, "source", "left").na.fill(0, ["mixed_tokens", "most_repeats", "least_repeats", "n_drawn"])
    out = out.withColumn("spent", (F.col("n_drawn") == F.col("n_docs")) & (F.col("least_repeats") == F.col("max_repeats")) | (F.col("source_tokens") == 0) | (F.col("max_repeats") == 0))
    return out.withColumn("actual_share", F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy())).select("source", "target_share", "actual_share", "target_tokens", "mixed_tokens", "source_tokens", "n_docs", "max_repeats", "most_repeats", "reachable", "spent")
