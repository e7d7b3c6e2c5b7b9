"""Vector, lexical and graph retrieval, and their composition into grounded rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomspan.functions import text
from loomspan.functions.partitions import spread
from loomspan.functions.shared import written


def cosine(a: Column, b: Column) -> Column:
    """Cosine over matching positions; null if either has no length. No join, no shuffle."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    return F.try_divide(dot, F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda p: p * p))))


#: Bytes of query vectors that go to every task at once.
QUERY_BYTES = 16 << 20
#: Different words that one automaton holds; more are searched in several.
AUTOMATON_WORDS = 200_000


def _blocks(rows: Iterator, size: int) -> Iterator[list]:
    block = []
    for r in rows:
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _cosines(items: pa.ListArray, queries: np.ndarray) -> np.ndarray:
    """Cosines of every query with every item over matching positions; NaN where one has no length there."""
    lengths = np.asarray(items.value_lengths().fill_null(0))
    flat, offsets = items.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(lengths)])
    out = np.full((len(queries), len(items)), np.nan)
    for n in np.unique(lengths[lengths > 0]).tolist():
        at, m = np.flatnonzero(lengths == n), min(n, queries.shape[1])
        x, q = flat[offsets[at][:, None] + np.arange(m)], queries[:, :m]
        with np.errstate(divide="ignore", invalid="ignore"):
            c = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
        out[:, at] = np.where(np.isfinite(c), c, np.nan)
    return out


def top_vectors(items: DataFrame, queries: DataFrame, k: int, item: str = "chunk_id", query: str = "query_id") -> DataFrame:
    """The k most similar items of every query, exactly: (query, item, similarity, distance, rank).

    ``queries`` (vectors of one length) is a stated set against all items: it is taken to them in blocks of at most
    QUERY_BYTES, one scan of the items each, and a batch of items meets a block in one matrix product. Each task
    keeps the best k of each query before the shuffle. Empty vectors, and those without length, take no part;
    cosines equal in 12 decimals are ties, broken by the item. For every item against all others see the
    optional package.
    """
    asked = queries.select(F.col(query), F.col("embedding").cast("array<double>").alias("_q")).where((F.size("_q") > 0) & F.col(query).isNotNull())
    scanned = items.where((F.size("embedding") > 0) & F.col(item).isNotNull()).select(F.col(item).alias("i"), F.col("embedding").cast("array<double>").alias("v"))
    kinds = f"q {asked.schema[query].dataType.simpleString()}, i {scanned.schema['i'].dataType.simpleString()}, similarity double"
    query_type = to_arrow_type(asked.schema[query].dataType)
    first = asked.first()
    if first is None:
        return scanned.sparkSession.createDataFrame([], f"{query} {asked.schema[query].dataType.simpleString()}, {item} {scanned.schema['i'].dataType.simpleString()}, similarity double, rank int, distance double")
    parts = []
    for block in _blocks(asked.toLocalIterator(prefetchPartitions=True), max(1, QUERY_BYTES // (8 * len(first["_q"])))):
        names, vectors = [r[0] for r in block], np.array([r["_q"] for r in block], np.float64)

        def score(batches: Iterator[pa.RecordBatch], names: list = names, vectors: np.ndarray = vectors) -> Iterator[pa.RecordBatch]:
            best_c, best_i = np.empty((len(names), 0)), np.empty((len(names), 0), object)
            kind = None
            for b in batches:
                kind = b.schema.field("i").type
                for low in range(0, b.num_rows, 2048):
                    part = b.slice(low, 2048)
                    c = np.round(_cosines(part.column("v"), vectors), 12)
                    ids = np.array(part.column("i").to_pylist(), object)
                    order = np.argsort(ids, kind="stable")
                    c, ids = np.concatenate([best_c, c[:, order]], axis=1), np.concatenate([best_i, np.tile(ids[order], (len(names), 1))], axis=1)
                    c = np.where(np.isnan(c), -2.0, c)
                    if c.shape[1] > k:
                        cut = np.partition(-c, k - 1, axis=1)[:, k - 1]
                        rows = []
                        for r in range(len(names)):
                            at = np.flatnonzero(-c[r] <= cut[r])
                            rows.append(sorted(at.tolist(), key=lambda j, r=r: (-c[r, j], ids[r, j]))[:k])
                        keep = np.array(rows)
                        c, ids = np.take_along_axis(c, keep, axis=1), np.take_along_axis(ids, keep, axis=1)
                    best_c, best_i = c, ids
            if kind is not None and best_c.shape[1]:
                row, at = np.nonzero(best_c > -1.5)
                yield pa.RecordBatch.from_arrays([pa.array([names[r] for r in row.tolist()], query_type), pa.array(best_i[row, at].tolist(), kind), pa.array(best_c[row, at])], names=["q", "i", "similarity"])

        parts.append(spread(scanned).mapInArrow(score, kinds))
    scored = reduce(DataFrame.unionByName, parts).select(F.col("q").alias(query), F.col("i").alias(item), "similarity")
    w = Window.partitionBy(query).orderBy(F.desc("similarity"), item)
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("distance", 1 - F.col("similarity"))


def holding_words(rows: DataFrame, columns: list[str], words: DataFrame) -> DataFrame:
    """``rows`` with word: once for each of the words (a column ``word``) that one of the columns contains, as they are.

    The different words become an automaton that reads each row once, however many they are; they go to the tasks in
    blocks of at most AUTOMATON_WORDS. Null columns contain nothing.
    """
    wanted = words.where(F.coalesce("word", F.lit("")) != "").select("word").distinct()
    flat = spread(rows.withColumn("_t", F.concat_ws("\n", *columns)))
    parts = []
    for block in _blocks((r[0] for r in wanted.toLocalIterator()), AUTOMATON_WORDS):

        def find(batches: Iterator[pa.RecordBatch], block: list[str] = block) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for x in block:
                automaton.add_word(x, x)
            automaton.make_automaton()
            for b in batches:
                at, found = [], []
                for r, t in enumerate(b.column("_t").to_pylist()):
                    hits = {x for _, x in automaton.iter(t)}
                    at += [r] * len(hits)
                    found += sorted(hits)
                taken = b.drop_columns(["_t"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], names=[*taken.schema.names, "word"])

        parts.append(flat.mapInArrow(find, rows.withColumn("word", F.lit("")).schema))
    return reduce(DataFrame.unionByName, parts) if parts else rows.withColumn("word", F.lit("")).limit(0)


def relevant(df: DataFrame, haystack: Column, words: Column | list[str], forms: Column | None = None) -> DataFrame:
    """Rows that a keyword list is about, with ``matches``. Rows without words are all kept.

    ``forms``: the words' :func:`~loomspan.functions.text.keyword_forms`, where they have been made before. A plain
    list of words is looked for in Arrow batches that give back the matches only.
    """
    normal = text.normalize_text(haystack)
    if isinstance(words, list):
        told = df.withColumn("matches", text.matched_arrow(normal, words))
        return told.where(text.is_relevant(F.col("matches"), F.array(*map(F.lit, words))))
    spoken = df.withColumn("_h", text.searchable_arrow(normal))
    return spoken.withColumn("matches", text.matched_keywords(F.col("_h"), words, forms)).where(text.is_relevant(F.col("matches"), words)).drop("_h")


def lexical_edges(edges: DataFrame, words: list[str], descriptions: bool = False) -> DataFrame:
    """Edges of which an end, or the relation, contains one of the words (both ends' descriptions on request)."""
    names = ["source_id", "source_label", "relation", "target_id", "target_label", *["source_description", "target_description"] * descriptions]
    cond = F.lit(False)
    for w in words:  # a short list, folded into one predicate for the scan
        for c in names:
            cond = cond | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w.lower()))
    return edges.where(cond)


def cited_once(citations: DataFrame, order: list[Column]) -> DataFrame:
    """Citations (url, document_id, chunk_index), the first of equal ones; those without URL are dropped."""
    keyed = citations.where(F.coalesce("url", F.lit("")) != "").withColumn("_k", F.concat_ws("::", "url", F.coalesce("document_id", F.lit("")), F.coalesce(F.col("chunk_index").cast("string"), F.lit(""))))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_n = 1").drop("_n", "_k")


def ground(questions: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 5, keep: int = 3, triples: int = 10) -> DataFrame:
    """One grounded row a question: (question_id, n_chunks, n_triples, context, citations, abstain).

    ``questions``: question_id, question, embedding. The k nearest chunks and the edges that contain a keyword
    are filtered by relevance; the best ``keep`` chunks and ``triples`` edges make the context; a question
    without context abstains.
    """
    q = questions.select("question_id", "embedding", text.keywords(F.col("question")).alias("words"))
    q = written(q.withColumn("few", F.slice("words", 1, 4)).withColumn("forms", text.keyword_forms(F.col("words"))), "questions")  # used five times
    near = written(top_vectors(chunks, q, k, "chunk_id", "question_id"), "near")  # a few ids a question: contents are looked up by these
    near = chunks.select("chunk_id", "content", "title", "source_url", "document_id", "chunk_index").join(near, "chunk_id").join(q.select("question_id", "words", "forms"), "question_id")
    near = relevant(near, F.concat_ws("\n", "title", "source_url", "content"), F.col("words"), F.col("forms"))
    best = Window.partitionBy("question_id").orderBy("rank", "chunk_id")
    near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep)
    got = near.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("_r", "content", F.col("source_url").alias("url")))).alias("c"))

    ends = ["source_id", "source_label", "relation", "target_id", "target_label"]
    spoken = F.concat_ws(" ", F.coalesce("source_label", "source_id"), "relation", F.coalesce("target_label", "target_id"))
    lines = edges.select(spoken.alias("line"), "source_url", *[F.lower(F.col(c)).alias(c) for c in ends]).distinct()
    asked = q.select("question_id", "words", "forms", F.explode("few").alias("word"))
    facts = holding_words(lines, ends, asked).select("line", "source_url", "word").distinct().join(asked, "word")
    first = Window.partitionBy("question_id").orderBy("line", "source_url")
    facts = facts.select("question_id", "line", "source_url", "words", "forms").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= triples)
    facts = relevant(facts, F.concat_ws("\n", "source_url", "line"), F.col("words"), F.col("forms"))
    said = facts.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("_r", "line", F.col("source_url").alias("url")))).alias("t"))

    out = q.select("question_id").join(got, "question_id", "left").join(said, "question_id", "left")
    c, t = (F.coalesce(F.col(n), F.array()) for n in ("c", "t"))
    lines = F.concat(F.transform(t, lambda x: x["line"]), F.transform(c, lambda x: x["content"]))
    cites = F.array_distinct(F.filter(F.concat(F.transform(t, lambda x: x["url"]), F.transform(c, lambda x: x["url"])), lambda u: F.coalesce(u, F.lit("")) != ""))
    n_c, n_t = (F.coalesce(F.size(F.col(n)), F.lit(0)) for n in ("c", "t"))
    return out.select("question_id", n_c.cast("long").alias("n_chunks"), n_t.cast("long").alias("n_triples"), F.array_join(lines, "\n\n").alias("context"), F.array_join(cites, " ").alias("citations"), (n_c + n_t == 0).alias("abstain"))
