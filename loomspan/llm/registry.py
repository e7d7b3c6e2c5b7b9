"""The queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.partitions import once, spread
from loomspan.functions.shared import scratch, written
from loomspan.llm import arrivals, batches, leakage, mixing, neighbours, pages, repeated_lines, residue, sentences, splitting

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_KEYS = ("document_id", "crawl_batch_id")

# --- 1: page bodies ------------------------------------------------------------------------------


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _table(spark, sf, "corpus").select(*_KEYS, "title", "content")
    models = residue.fit(corpus)
    return pages.furniture_lines(once(corpus), _KEYS, unless=lambda t, c: [kind is not None for kind in residue.classify_all(t, c, models)])


def p1_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return pages.bodies(once(_table(spark, sf, "corpus").select(*_KEYS, "title", "content")), _KEYS, "content", "title")


def p1_chunk_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return pages.bodies(once(_table(spark, sf, "chunks").select("chunk_id", "title", "content")), ("chunk_id",), "content", "title")


# --- 2: nearest vectors --------------------------------------------------------------------------


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest(_table(spark, sf, "chunks")))


def p2_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf, "chunks"))


# --- 3: new batches against history --------------------------------------------------------------


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return batches.repeats(_table(spark, sf, "corpus"), _table(spark, sf, "crawl_batches"), scratch(spark, "history"), arrivals.ARRIVALS)


#: Brute force: all pairs of texts that share a run of words, and acceptance batch after batch.
P3_FOUND_SQL = r"""
WITH RECURSIVE b AS (SELECT crawl_batch_id, min(batch_seq) AS seq FROM crawl_batches GROUP BY 1),
t AS (SELECT DISTINCT document_id, crawl_batch_id, content_hash, content, coalesce(seq, 4611686018427387904) AS seq FROM corpus LEFT JOIN b USING (crawl_batch_id)
      WHERE document_id IS NOT NULL AND crawl_batch_id IS NOT NULL AND (content IS NOT NULL OR content_hash IS NOT NULL)),
w AS (SELECT *, regexp_extract_all(lower(strip_accents(content)), '[\p{L}\p{N}]+') AS w FROM t),
g AS (SELECT * EXCLUDE w, CASE WHEN content IS NULL THEN ['H:' || content_hash] WHEN len(w) = 0 THEN ['T:' || trim(content)] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
r AS MATERIALIZED (SELECT *, md5(array_to_string(list_sort(g), '|')) AS node FROM g),
n AS MATERIALIZED (SELECT node, any_value(g) AS g, min({'s': seq, 'd': document_id, 'b': crawl_batch_id}) AS f FROM r GROUP BY node),
u AS MATERIALIZED (SELECT node, unnest(g) AS x FROM n),
near AS (SELECT a.node AS a, c.node AS b, count(*) AS k FROM u a JOIN u c ON a.x = c.x AND a.node < c.node GROUP BY ALL),
pairs AS (SELECT a, b FROM near JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE k >= 0.5 * (len(x.g) + len(y.g) - k)
          UNION SELECT DISTINCT p.node, q.node FROM r p JOIN r q ON p.content_hash = q.content_hash AND p.node < q.node),
links AS MATERIALIZED (SELECT CASE WHEN x.f.s > y.f.s THEN a ELSE b END AS later, CASE WHEN x.f.s > y.f.s THEN b ELSE a END AS earlier FROM pairs JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE x.f.s <> y.f.s),
steps AS MATERIALIZED (SELECT s, row_number() OVER (ORDER BY s) AS i FROM (SELECT DISTINCT seq AS s FROM r)),
run AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS acc UNION ALL
        SELECT run.i + 1, list_concat(acc, coalesce((SELECT list(n.node) FROM n WHERE n.f.s = steps.s AND NOT EXISTS (SELECT 1 FROM links WHERE links.later = n.node AND list_contains(run.acc, links.earlier))), [])) FROM run JOIN steps ON steps.i = run.i + 1),
acc AS MATERIALIZED (SELECT unnest(acc) AS node FROM (SELECT acc FROM run ORDER BY i DESC LIMIT 1)),
kept AS (SELECT later AS node, arg_min(earlier, n.f) AS k FROM links JOIN acc ON acc.node = earlier JOIN n ON n.node = earlier WHERE later NOT IN (SELECT node FROM acc) GROUP BY later),
cases AS (SELECT r.document_id, r.crawl_batch_id, r.content_hash, coalesce(k, r.node) AS k, n.f AS f FROM r LEFT JOIN kept USING (node) JOIN n ON n.node = coalesce(k, r.node) WHERE content IS NOT NULL AND n.f.s < r.seq),
good AS (SELECT r.* FROM r JOIN acc USING (node) JOIN n USING (node) WHERE r.seq = n.f.s)
SELECT DISTINCT document_id, crawl_batch_id, coalesce((SELECT min(document_id) FROM good WHERE good.node = c.k AND good.content_hash = c.content_hash), (SELECT min(document_id) FROM good WHERE good.node = c.k AND good.document_id = c.document_id), c.f.d) AS kept_document_id FROM cases c
"""

# --- 4: repeated lines ---------------------------------------------------------------------------


def _line_arrivals(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The corpus as it arrives, batch after batch: what each arrival adds to the line counts."""
    corpus = arrivals.numbered(spread(_table(spark, sf, "corpus").select("crawl_batch_id", "source_name", "document_id", "content")), _table(spark, sf, "crawl_batches"))
    delta = written(repeated_lines.line_delta(corpus, "arrival"), "lines", by="arrival")
    return [delta.where(F.col("arrival") == k).drop("arrival") for k in range(arrivals.ARRIVALS)]


def _repeated(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.repeated_lines(_table(spark, sf, "corpus"), scratch(spark, "line-state"), _line_arrivals(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _repeated(spark, sf).select("source_name", "line_key")


def p4_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    corpus = once(_table(spark, sf, "corpus").select(*_KEYS, "source_name", "content"))
    return repeated_lines.rebuild(corpus, _repeated(spark, sf), list(_KEYS))


_LINE_KEY = r"regexp_replace(lower(trim(regexp_replace(line, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{b}]+', ' ', 'g'))), '[0-9]+', '#', 'g')"
P4_FOUND_SQL = f"""
WITH lines AS (SELECT DISTINCT source_name, document_id, unnest(string_split(content, chr(10))) AS line
               FROM corpus WHERE source_name IS NOT NULL AND document_id IS NOT NULL),
keyed AS (SELECT DISTINCT source_name, document_id, {_LINE_KEY} AS line_key FROM lines),
totals AS (SELECT source_name, count(DISTINCT document_id) AS n FROM corpus WHERE source_name IS NOT NULL GROUP BY source_name)
SELECT k.source_name, k.line_key FROM keyed k JOIN totals t USING (source_name)
WHERE regexp_matches(k.line_key, '\\p{{L}}')
GROUP BY k.source_name, k.line_key, t.n HAVING count(*) >= 5 AND count(*) >= 0.05 * t.n
"""

P4_CLEANED_SQL = f"""
WITH found AS ({P4_FOUND_SQL}),
lines AS (SELECT document_id, crawl_batch_id, source_name, i, string_split(content, chr(10))[i] AS line
          FROM (SELECT DISTINCT document_id, crawl_batch_id, source_name, content FROM corpus WHERE source_name IS NOT NULL AND content IS NOT NULL), unnest(range(1, len(string_split(content, chr(10))) + 1)) AS u(i)),
marked AS (SELECT l.*, f.line_key IS NOT NULL AS gone FROM (SELECT *, {_LINE_KEY} AS k FROM lines) l LEFT JOIN found f ON f.source_name = l.source_name AND f.line_key = l.k)
SELECT document_id, crawl_batch_id, source_name, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS content, count(*) FILTER (WHERE gone) AS n_removed
FROM marked GROUP BY document_id, crawl_batch_id, source_name HAVING bool_or(gone)
"""

# --- 5: template residue -------------------------------------------------------------------------


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(_table(spark, sf, "corpus")).select(*_KEYS).distinct()


def p5_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(_table(spark, sf, "corpus"))


# --- 6: splitting --------------------------------------------------------------------------------


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _table(spark, sf, "chunks").where(F.col("chunk_id").isNotNull())
    pieces = splitting.split_oversized(chunks, ["chunk_id"], "content").where(F.length("content") <= splitting.LIMIT)
    return pieces.where("n_pieces > 1").select("chunk_id").distinct()


def p6_chunk_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of the chunks over the limit; a chunk_id with several contents has the pieces of each."""
    chunks = _table(spark, sf, "chunks").select("chunk_id", "content").where(F.length("content") > splitting.LIMIT)
    return splitting.split_oversized(once(chunks), ["chunk_id"], "content")


def p6_article_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(once(_table(spark, sf, "corpus").select(*_KEYS, "content")), list(_KEYS), "content")


P6_FOUND_SQL = "SELECT DISTINCT chunk_id FROM chunks WHERE length(content) > 1200 AND chunk_id IS NOT NULL"

# --- 7: leakage ----------------------------------------------------------------------------------


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    index = written(leakage.build_index(_table(spark, sf, "documents")), "postings")
    return leakage.search_index(index, _table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_proximity(spark: SparkSession, sf: str) -> DataFrame:
    index = written(leakage.build_index(_table(spark, sf, "documents")), "postings")
    return leakage.search_index(index, _table(spark, sf, "eval_items"), slop=leakage.SLOP)


P7_FOUND_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(strip_accents(item_text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL AND item_id IS NOT NULL),
dr AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS run FROM d, unnest(range(1, len(w) - 10)) AS u(k)),
ir AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS run FROM i, unnest(range(1, len(w) - 10)) AS u(k))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)
"""

# --- 8: mixing -----------------------------------------------------------------------------------


def _listed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = _table(spark, sf, "mix_targets")
    documents = spread(_table(spark, sf, "documents")).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    return documents, targets


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    documents, targets = _listed(spark, sf)
    weighted = documents.withColumn("weight", mixing.letter_share(F.col("text")))
    sizes = written(mixing.count_tokens(weighted, ["doc_id", "source", "weight"], "text"), "sizes")
    plan = mixing.plan_mix(sizes, targets)
    return mixing.draw_mix(sizes, plan), plan


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of which the mix holds everything as often as it may, and still less than their share."""
    shares = mixing.report_shares(*_mixed(spark, sf))
    return shares.where(F.col("spent") & (F.col("mixed_tokens") < F.col("target_tokens"))).select("source")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.report_shares(*_mixed(spark, sf))


#: With a byte for a token: no case hangs on the choice of tokenizer.
P8_FOUND_SQL = """
WITH targets AS (SELECT source, min(target_share) AS share, min(max_repeats) AS repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY source),
have AS (SELECT source, sum(coalesce(strlen(text), 0)) AS n FROM documents WHERE source IN (SELECT source FROM targets) GROUP BY source)
SELECT source FROM targets LEFT JOIN have USING (source)
WHERE repeats * coalesce(n, 0) < share * (SELECT sum(n) FROM have)
"""

# --- 9: sentences --------------------------------------------------------------------------------


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(_table(spark, sf, "documents"), with_text=False).select("doc_id", "start_pos", "end_pos")


def p9_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(_table(spark, sf, "documents"))


def queries() -> dict[str, Query]:
    names = "p1_found p1_bodies p1_chunk_bodies p5_found p5_kinds p2_found p2_nearest p3_found p4_found p4_cleaned p6_found p6_chunk_pieces p6_article_pieces p7_found p7_proximity p8_found p8_mix p8_shares p9_found p9_sentences"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND_SQL, "p4_found": P4_FOUND_SQL, "p4_cleaned": P4_CLEANED_SQL, "p6_found": P6_FOUND_SQL, "p7_found": P7_FOUND_SQL, "p8_found": P8_FOUND_SQL}
