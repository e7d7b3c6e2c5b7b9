"""Model calls as Arrow batches: embeddings and graph extraction by a function that is handed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import normalize_text

Embed = Callable[[list[str]], list[list[float]]]


def feature_hash(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Unit vectors of hashed words, where no model is at hand: the same text gives the same vector everywhere."""
    out = np.zeros((len(texts), dim))
    for r, t in enumerate(texts):
        for w in t.split():
            h = xxhash.xxh64_intdigest(w)
            out[r, h % dim] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).tolist()


def embedded(df: DataFrame, text: str, embed: Embed = feature_hash, batch: int = 256) -> DataFrame:
    """``df`` with embedding (array of doubles) of a text column. Texts that are the same when normalised are embedded once;
    a call that fails gives empty vectors, as do null texts and those without a letter or digit of a-z and 0-9."""
    keyed = df.withColumn("_key", F.coalesce(normalize_text(F.col(text)), F.lit("")))
    one = keyed.where(F.col("_key") != "").select("_key").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, batch):
                keys = b.column("_key").slice(low, batch)
                try:
                    vectors = embed(keys.to_pylist())
                except Exception:  # noqa: BLE001 a failed call is an empty vector
                    vectors = [[]] * len(keys)
                yield pa.RecordBatch.from_arrays([keys, pa.array(vectors, pa.list_(pa.float64()))], names=["_key", "embedding"])

    vectors = one.mapInArrow(run, "_key string, embedding array<double>")
    return keyed.join(vectors, "_key", "left").withColumn("embedding", F.coalesce("embedding", F.array().cast("array<double>"))).drop("_key")


def extracted(df: DataFrame, key: str, text: str, extract: Callable[[str], list[tuple[str, str, str]]], most: int = 9_000) -> DataFrame:
    """(``key``, source, relation, target) that a function finds in the first ``most`` characters of each text (the model's
    limit). A call that fails, and a null text, give nothing; the same triple of a text counts once."""
    rows = df.select(F.col(key).alias("k"), F.substring(text, 1, most).alias("t")).where(F.col("t").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for r, t in enumerate(b.column("t").to_pylist()):
                try:
                    got = list(dict.fromkeys(extract(t)))
                except Exception:  # noqa: BLE001
                    got = []
                at += [r] * len(got)
                found += got
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], names=["k", "source", "relation", "target"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, source string, relation string, target string").withColumnRenamed("k", key)
