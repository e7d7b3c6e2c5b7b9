"""Queries on texts, identities, chunks, vectors and retrieval, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import ids, text, urls
from loomspan.functions.partitions import once
from loomspan.operators import merging, retrieval
from loomspan.plans.common import Plans, newest_corpus, sql_in, table

plans = Plans()

# SQL pieces shared by several oracles
NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower({c})), '[''‘’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_ALIAS = "coalesce(map_extract(MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in text.ALIASES.items()) + "}, {w})[1], {w})"


def norm(c: str) -> str:
    return NORM.replace("{c}", c)


def alias_sql(w: str) -> str:
    return _ALIAS.replace("{w}", w)


def lemma_sql(w: str) -> str:
    base = alias_sql(w)
    cut = f"regexp_replace({base}, '^(.{{4,}}?)(?:{'|'.join(text.SUFFIXES)})$', '\\1')"
    cut = f"regexp_replace({cut}, '^(?:{'|'.join(text.PREFIXES)})(.{{4,}})$', '\\1')"
    return f"CASE WHEN {base} IN ({sql_in(text.PROTECTED)}) OR length({base}) <= 4 THEN {base} ELSE {alias_sql(cut)} END"


def words_sql(c: str) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda w: w <> '')"


NEWEST = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST, crawl_batch_id DESC NULLS LAST, content_hash DESC NULLS LAST) AS rn
 FROM corpus WHERE document_id IS NOT NULL) WHERE rn = 1)"""
URL = r"""CASE WHEN regexp_matches(trim(u), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') THEN
 (CASE WHEN regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+([^?]*)', 1) IN ('', '/') AND true THEN
   lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)', 1)) || '/' || q
  ELSE regexp_replace(lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)', 1)) || regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+([^?]*)', 1) || q, '/$', '') END)
 ELSE regexp_replace(b, '/$', '') END"""


def urls_cte(source: str, column: str) -> str:
    """CTE url_map(u, canonical) for a column of URLs (the tables hold no explicit ports)."""
    return f"""u0 AS (SELECT DISTINCT {column} AS u FROM {source} WHERE {column} IS NOT NULL),
u1 AS (SELECT u, regexp_replace(trim(u), '#.*$', '') AS b FROM u0),
u2 AS (SELECT u, b, list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda x: x <> '') AS ps FROM u1),
u3 AS (SELECT u, b, CASE WHEN len(ps) = 0 THEN '' ELSE '?' || array_to_string(list_transform(list_sort(list_transform(ps, lambda x, i: {{'n': regexp_extract(x, '^([^=]*)', 1), 'i': i, 'p': x}})), lambda x: x.p), '&') END AS q FROM u2),
url_map AS (SELECT u, {URL} AS canonical FROM u3)"""


@plans.add(f"SELECT doc_id, {norm('text')} AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@plans.add("SELECT DISTINCT title, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (SELECT title, substr(regexp_replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS s FROM corpus WHERE title IS NOT NULL)")
def slugify_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus").where("title IS NOT NULL").select("title").distinct().withColumn("slug", text.slugify(F.col("title")))


@plans.add(f"WITH t AS (SELECT unnest({words_sql('text')}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM t GROUP BY token) SELECT token, {lemma_sql('token')} AS lemma, n FROM c")
def lemma_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words are counted before they are lemmatised: each distinct word is looked at once."""
    words = table(spark, sf, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).select("token", text.lemma(F.col("token")).alias("lemma"), "n")


_KEYWORDS = f"""WITH p AS (SELECT DISTINCT event_id, prompt FROM response_feedback WHERE prompt IS NOT NULL),
w AS (SELECT event_id, prompt, list_filter(list_transform({words_sql('prompt')}, lambda w: {lemma_sql('w')}), lambda w: length(w) > 3 AND w NOT IN ({sql_in(text.STOPWORDS)})) AS ws FROM p)
SELECT event_id, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') AS keywords FROM w"""


@plans.add(_KEYWORDS)
def keywords(spark: SparkSession, sf: str) -> DataFrame:
    prompts = table(spark, sf, "response_feedback").where("prompt IS NOT NULL").select("event_id", "prompt").distinct()
    return prompts.select("event_id", F.array_join(text.keywords(F.col("prompt")), " ").alias("keywords"))


_PACK = r"""WITH {newest},
paras AS (SELECT document_id, list_filter(list_transform(regexp_split_to_array(content, '\n+'), lambda x: regexp_replace(x, '^[\s\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}\x{{b}}]+|[\s\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}\x{{b}}]+$', '', 'g')), lambda x: length(x) > 20) AS ps FROM newest WHERE content IS NOT NULL),
folded AS (SELECT document_id, list_reduce(list_prepend({{'c': '', 'o': CAST([] AS VARCHAR[])}}, list_transform(ps, lambda x: {{'c': x, 'o': CAST([] AS VARCHAR[])}})),
 lambda a, p: CASE WHEN a.c = '' THEN {{'c': p.c, 'o': a.o}} WHEN length(a.c) + length(p.c) + 1 <= 1200 THEN {{'c': a.c || chr(10) || p.c, 'o': a.o}} ELSE {{'c': p.c, 'o': list_append(a.o, a.c)}} END) AS f FROM paras),
packed AS (SELECT document_id, CASE WHEN f.c = '' THEN f.o ELSE list_append(f.o, f.c) END AS cs FROM folded),
pieces AS (SELECT document_id, unnest(cs) AS content, unnest(range(len(cs))) AS chunk_index FROM packed)
""".replace("{newest}", NEWEST).replace("{{", "{").replace("}}", "}")


def _chunked(spark: SparkSession, sf: str) -> DataFrame:
    docs = newest_corpus(spark, sf).where("content IS NOT NULL")
    return docs.select("document_id", F.posexplode(text.chunks(F.col("content"))).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@plans.add(_PACK + "SELECT document_id, chunk_index, substr(sha256(document_id || ':' || chunk_index || ':' || content), 1, 24) AS chunk_id, content FROM pieces")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf).select("document_id", "chunk_index", ids.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("content")).alias("chunk_id"), "content")


@plans.add(_PACK + "SELECT source_name, count(*) AS n_chunks, max(length(p.content)) AS longest, sum(length(p.content))::BIGINT AS characters FROM pieces p JOIN newest USING (document_id) GROUP BY source_name")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = newest_corpus(spark, sf).where("content IS NOT NULL").select("source_name", F.explode(text.chunks(F.col("content"))).alias("c"))
    return docs.groupBy("source_name").agg(F.count("*").alias("n_chunks"), F.max(F.length("c")).cast("long").alias("longest"), F.sum(F.length("c")).alias("characters"))


_TRIM = r"regexp_replace({c}, '^[\s\x{a0}\x{b}\x{2000}-\x{200a}\x{3000}\x{feff}]+|[\s\x{a0}\x{b}\x{2000}-\x{200a}\x{3000}\x{feff}]+$', '', 'g')"
_IDENTITY = f"""WITH {urls_cte('corpus', 'source_url')}
SELECT DISTINCT document_id, 'web-' || substr(sha256(canonical), 1, 24) AS url_id,
 sha256(canonical || chr(10) || {_TRIM.replace('{c}', "coalesce(title, '')")} || chr(10) || {_TRIM.replace('{c}', "replace(replace(coalesce(content, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))")}) AS content_hash
FROM corpus JOIN url_map ON source_url = u"""


@plans.add(_IDENTITY)
def doc_identity(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "corpus").where("source_url IS NOT NULL")
    return c.select("document_id", ids.document_id(F.col("source_url")).alias("url_id"), ids.content_hash(F.col("source_url"), F.col("title"), F.col("content")).alias("content_hash")).distinct()


@plans.add("SELECT content_hash, min(document_id) AS document_id, count(DISTINCT document_id) AS n_documents FROM corpus WHERE content_hash IS NOT NULL GROUP BY content_hash")
def dedupe_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "corpus").where("content_hash IS NOT NULL")
    return c.groupBy("content_hash").agg(F.min("document_id").alias("document_id"), F.count_distinct("document_id").alias("n_documents"))


_COMPACT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '!\[[^\]]*\]\([^)]+\)', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@plans.add(f"WITH m AS (SELECT DISTINCT document_id, crawl_batch_id, {_COMPACT} AS c FROM corpus WHERE content IS NOT NULL) SELECT document_id, crawl_batch_id, length(c)::BIGINT AS n_chars, length(c) >= 450 AND (length(c) >= 900 OR NOT regexp_matches(lower(c), 'cookie|privacy policy|javascript|enable cookies')) AS is_article FROM m")
def quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "corpus").where("content IS NOT NULL").select("document_id", "crawl_batch_id", text.compact_markdown(F.col("content")).alias("c"))
    return c.select("document_id", "crawl_batch_id", F.length("c").cast("long").alias("n_chars"), text.is_article(F.col("c")).alias("is_article"), "c").distinct().drop("c")


QUESTION_WORDS = ["zakat", "wakaf", "pinjaman", "tanaman"]
_MATCH = f"""WITH c AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE content IS NOT NULL AND chunk_id IS NOT NULL),
h AS (SELECT chunk_id, content, ' ' || trim({norm('content')} || ' ' || array_to_string(list_transform({words_sql('content')}, lambda w: {lemma_sql('w')}), ' ')) || ' ' AS h FROM c),
m AS (SELECT chunk_id, content, list_filter([{sql_in(QUESTION_WORDS)}], lambda k: contains(h, ' ' || {lemma_sql('k')} || ' ')) AS ms FROM h)
SELECT chunk_id, array_to_string(ms, ' ') AS matches FROM m WHERE len(ms) >= 2 OR len(list_filter(ms, lambda x: length(x) >= 8)) > 0"""


@plans.add(_MATCH)
def keyword_relevance(spark: SparkSession, sf: str) -> DataFrame:
    c = once(table(spark, sf, "chunks").where("content IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", "content"))
    return retrieval.relevant(c, F.col("content"), list(QUESTION_WORDS)).select("chunk_id", F.array_join("matches", " ").alias("matches"))


_COS = "list_cosine_similarity({a}, {b})"


@plans.add("WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS c FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(c, 6) AS similarity, round(1 - c, 6) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def vector_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Questions are the vectors whose id is divisible by 20: a stated query set against all rows."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    top = retrieval.top_vectors(e, e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5, "vec_id", "query_id")
    return top.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"), "rank")


_ONE_QUERY = "(SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)"


@plans.add(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS similarity FROM embeddings, {_ONE_QUERY} ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """One question vector as a literal: TakeOrderedAndProject, without a join."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    v = F.array(*[F.lit(float(x)) for x in e.orderBy("vec_id").first()["embedding"]])
    return e.withColumn("s", retrieval.cosine(F.col("embedding"), v)).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("similarity"))


@plans.add("""WITH c AS (SELECT * FROM (SELECT chunk_id, embedding, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, crawl_batch_id DESC NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL AND embedding IS NOT NULL) WHERE rn = 1),
s AS (SELECT chunk_id, list_slice(embedding, 1, least(len(embedding), 64)) AS a, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1) AS q FROM c WHERE len(embedding) > 0),
t AS (SELECT chunk_id, a, list_slice(q, 1, len(a)) AS b FROM s)
SELECT chunk_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS similarity FROM t WHERE list_dot_product(a, a) > 0""")
def positional_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of unequal length: only matching positions count, in product and norms."""
    c = table(spark, sf, "chunks").where("chunk_id IS NOT NULL AND embedding IS NOT NULL").select("chunk_id", "embedding", "created_at", "crawl_batch_id")
    c = merging.latest_by(c, ["chunk_id"], [F.desc("created_at"), F.desc_nulls_last("crawl_batch_id")])
    e = table(spark, sf, "embeddings").orderBy("vec_id").first()["embedding"]
    q = F.array(*[F.lit(float(x)) for x in e])
    return c.where("size(embedding) > 0").select("chunk_id", F.round(retrieval.cosine(F.col("embedding"), q), 6).alias("similarity")).where("similarity IS NOT NULL")


_SEARCHABLE = "' ' || trim({n} || ' ' || array_to_string(list_transform({w}, lambda w: {l}), ' ')) || ' '"


def _searchable_sql(c: str) -> str:
    return _SEARCHABLE.replace("{n}", norm(c)).replace("{w}", words_sql(c)).replace("{l}", lemma_sql("w"))


def _relevant_sql(hay: str, words: str) -> str:
    """Matches of a keyword list in a searchable text, the keywords lemmatised once more (a keyword is one word)."""
    return f"list_filter({words}, lambda k: contains({hay}, ' ' || {lemma_sql('k')} || ' '))"


_OK = "(len(ms) >= 2 OR len(list_filter(ms, lambda x: length(x) >= 8)) > 0 OR len(words) = 0)"
HYBRID_SQL = f"""WITH ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, crawl_batch_id DESC NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL AND len(embedding) = 96) WHERE rn = 1),
q0 AS (SELECT chunk_id AS question_id, title, embedding AS v FROM ch WHERE chunk_index = 0 AND title IS NOT NULL AND ('0x' || substr(md5(chunk_id), 1, 8))::BIGINT % 20 = 0),
q1 AS (SELECT question_id, v, list_filter(list_transform({words_sql('title')}, lambda w: {lemma_sql('w')}), lambda w: length(w) > 3 AND w NOT IN ({sql_in(text.STOPWORDS)})) AS ws FROM q0),
q AS (SELECT question_id, v, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS words FROM q1),
s AS (SELECT question_id, words, ch.chunk_id, content, title, source_url, list_cosine_similarity(embedding, v) AS c FROM ch, q WHERE list_dot_product(embedding, embedding) > 0 AND list_dot_product(v, v) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY c DESC, chunk_id) AS rank FROM s),
h AS (SELECT question_id, words, chunk_id, content, source_url, rank, {_searchable_sql("concat_ws(chr(10), title, source_url, content)")} AS h FROM r WHERE rank <= 5),
m AS (SELECT *, {_relevant_sql('h', 'words')} AS ms FROM h),
near AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, chunk_id) AS n FROM m WHERE {_OK}),
c AS (SELECT question_id, list(content ORDER BY n) FILTER (content IS NOT NULL) AS texts, list(source_url ORDER BY n) AS urls, count(*) AS k FROM near WHERE n <= 3 GROUP BY question_id),
f0 AS (SELECT DISTINCT question_id, words, concat_ws(' ', coalesce(source_label, source_id), relation, coalesce(target_label, target_id)) AS line, source_url FROM graph_edges, q
 WHERE len(list_filter(list_slice(words, 1, 4), lambda w: contains(lower(coalesce(source_id, '')), w) OR contains(lower(coalesce(source_label, '')), w) OR contains(lower(coalesce(relation, '')), w) OR contains(lower(coalesce(target_id, '')), w) OR contains(lower(coalesce(target_label, '')), w))) > 0),
f1 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY line, source_url NULLS FIRST) AS n FROM f0),
f2 AS (SELECT *, {_searchable_sql("concat_ws(chr(10), source_url, line)")} AS h FROM f1 WHERE n <= 10),
f3 AS (SELECT *, {_relevant_sql('h', 'words')} AS ms FROM f2),
t AS (SELECT question_id, list(line ORDER BY n) AS texts, list(source_url ORDER BY n) AS urls, count(*) AS k FROM f3 WHERE {_OK} GROUP BY question_id),
j AS (SELECT q.question_id, coalesce(c.k, 0) AS n_chunks, coalesce(t.k, 0) AS n_triples, coalesce(t.texts, []) || coalesce(c.texts, []) AS texts, list_filter(coalesce(t.urls, []) || coalesce(c.urls, []), lambda x: coalesce(x, '') <> '') AS urls FROM q LEFT JOIN c USING (question_id) LEFT JOIN t USING (question_id))
SELECT question_id, n_chunks, n_triples, coalesce(array_to_string(texts, chr(10) || chr(10)), '') AS context, coalesce(array_to_string(list_filter(urls, lambda x, i: list_position(urls, x) = i), ' '), '') AS citations, n_chunks + n_triples = 0 AS abstain FROM j"""


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Questions are the titles of lead chunks whose hashed id is divisible by 20, embedded as these: a stated query set."""
    chunks = merging.latest_by(table(spark, sf, "chunks").where("chunk_id IS NOT NULL AND size(embedding) = 96"), ["chunk_id"], [F.desc("created_at"), F.desc_nulls_last("crawl_batch_id")])
    numbered = F.conv(F.substring(F.md5("chunk_id"), 1, 8), 16, 10).cast("long")
    asked = chunks.where(F.expr("chunk_index = 0 AND title IS NOT NULL") & (numbered % 20 == 0)).select(F.col("chunk_id").alias("question_id"), F.col("title").alias("question"), "embedding")
    return retrieval.ground(asked, chunks, table(spark, sf, "graph_edges"))


plans.put("hybrid_retrieve", hybrid, HYBRID_SQL)


@plans.add("""WITH f AS (SELECT DISTINCT event_id, citations_json FROM response_feedback WHERE citations_json IS NOT NULL AND json_valid(citations_json)),
c AS (SELECT event_id, unnest(from_json(citations_json, '[{"title":"VARCHAR","url":"VARCHAR"}]')) AS c FROM f WHERE json_type(citations_json) = 'ARRAY')
SELECT c.url AS url, min(c.title) AS title, count(DISTINCT event_id) AS n_answers FROM c WHERE c.url IS NOT NULL AND c.url <> '' GROUP BY c.url""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "response_feedback").select("event_id", "citations_json").distinct()
    c = f.select("event_id", F.explode(F.from_json("citations_json", "array<struct<title:string,url:string>>")).alias("c")).where("c.url IS NOT NULL AND c.url <> ''")
    return c.groupBy("c.url").agg(F.min("c.title").alias("title"), F.count_distinct("event_id").alias("n_answers"))


@plans.add(f"WITH {urls_cte('corpus', 'source_url')} SELECT u AS source_url, canonical, regexp_replace(regexp_extract(lower(u), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '^www\\.', '') AS host FROM url_map")
def normalize_urls(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "corpus").where("source_url IS NOT NULL").select("source_url").distinct()
    return u.select("source_url", urls.normalize_url(F.col("source_url")).alias("canonical"), urls.host(F.col("source_url")).alias("host"))


_PAGE = "'<html><head><title>' || title || '</title><script>var a = \"<p>\";</script><style>p {}</style></head><body><!-- nav --><svg><a href=\"#x\"></a></svg><a href=\"' || source_url || '#top\">x</a><a href=''mailto:a@b.example''>m</a><a href=\"/arkib?b=2&amp;a=1\">y</a><p>' || replace(content, chr(10), '<br/>') || '</p></body></html>'"
_PAGES = f"pages AS (SELECT DISTINCT document_id, source_url, {_PAGE} AS html FROM corpus WHERE title IS NOT NULL AND content IS NOT NULL AND NOT regexp_matches(title || content, '[<>]'))"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "corpus").where("title IS NOT NULL AND content IS NOT NULL AND NOT (concat(title, content) rlike '[<>]')")
    html = F.expr("concat('<html><head><title>', title, '</title><script>var a = \"<p>\";</script><style>p {}</style></head><body><!-- nav --><svg><a href=\"#x\"></a></svg><a href=\"', source_url, '#top\">x</a><a href=\\'mailto:a@b.example\\'>m</a><a href=\"/arkib?b=2&amp;a=1\">y</a><p>', replace(content, '\n', '<br/>'), '</p></body></html>')")
    return c.select("document_id", "source_url", html.alias("html")).distinct()


@plans.add(f"WITH {_PAGES} SELECT document_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '(?is)<svg\\b.*?</svg>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g'), '[\\s\\x{{b}}]+', ' ', 'g')) AS body FROM pages")
def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("document_id", text.html_title(F.col("html")).alias("title"), text.html_text(F.col("html")).alias("body"))


@plans.add(f"""WITH {_PAGES}, {urls_cte('corpus', 'source_url')}
SELECT DISTINCT source_url, canonical AS link FROM pages JOIN url_map ON source_url = u
UNION SELECT DISTINCT source_url, lower(regexp_extract(source_url, '^([A-Za-z]+://[^/?#]+)', 1)) || '/arkib?a=1&b=2' AS link FROM pages""")
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf)
    return p.select("source_url", F.explode(urls.links(text.strip_html(F.col("html")), F.col("source_url"))).alias("link")).distinct()


@plans.add("WITH m AS (SELECT DISTINCT document_id, metadata_json FROM corpus WHERE metadata_json IS NOT NULL AND json_valid(metadata_json)) SELECT document_id, json_extract_string(metadata_json, '$.contentHash') AS hash_head, try_cast(json_extract_string(metadata_json, '$.depth') AS BIGINT) AS depth FROM m")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Broken JSON gives no row: it parses to null."""
    m = table(spark, sf, "corpus").where("metadata_json IS NOT NULL").select("document_id", "metadata_json").distinct()
    p = m.select("document_id", F.try_parse_json("metadata_json").alias("v")).where("v IS NOT NULL")
    return p.select("document_id", F.try_variant_get("v", "$.contentHash", "string").alias("hash_head"), F.coalesce(F.try_variant_get("v", "$.depth", "bigint")).alias("depth"))


_WORDS = "|".join(text.RULINGS)


@plans.add(f"WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)\\b({_WORDS})\\b', 1), lambda x: upper(x)) AS r FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(r, ' ') AS rulings FROM d WHERE len(r) > 0")
def ruling_extract(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", text.rulings(F.col("text")).alias("r"))
    return d.where("size(r) > 0").select("doc_id", F.array_join("r", " ").alias("rulings"))


@plans.add("SELECT DISTINCT title, CASE WHEN length(title) <= 40 THEN title ELSE substr(title, 1, 37) || '...' END AS cut, CASE WHEN title = '' THEN '-' WHEN length(title) <= 24 THEN title ELSE trim(substr(title, 1, 23)) || '...' END AS label FROM corpus WHERE title IS NOT NULL")
def label_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "corpus").where("title IS NOT NULL").select("title").distinct()
    return t.select("title", text.truncate(F.col("title"), 40).alias("cut"), text.compact_label(F.col("title"), 24).alias("label"))


_BLOCK_KIND = "CASE WHEN regexp_matches(l, '^# ') THEN 'h1' WHEN regexp_matches(l, '^## ') THEN 'h2' WHEN regexp_matches(l, '^#{3,} ') THEN 'h3' WHEN regexp_matches(l, '^[-*] ') THEN 'ul' WHEN regexp_matches(l, '^[0-9]+[.)] ') THEN 'ol' ELSE 'p' END"


@plans.add(f"""WITH {NEWEST}, s AS (SELECT document_id, string_split(replace(content, chr(13), ''), chr(10)) AS ls FROM newest WHERE content IS NOT NULL),
r AS (SELECT document_id, trim(unnest(ls)) AS l, unnest(range(len(ls))) AS i FROM s), k AS (SELECT document_id, i, {_BLOCK_KIND} AS kind FROM r WHERE l <> ''),
e AS (SELECT *, CASE WHEN kind IN ('ul', 'ol') AND lag(kind) OVER (PARTITION BY document_id ORDER BY i) = kind THEN 0 ELSE 1 END AS starts FROM k),
g AS (SELECT *, sum(starts) OVER (PARTITION BY document_id ORDER BY i) AS block FROM e)
SELECT document_id, block::BIGINT AS block, any_value(kind) AS kind, count(*) AS n_lines FROM g GROUP BY document_id, block""")
def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a markdown text: neighbouring list lines of a kind are one block (gaps and islands)."""
    docs = newest_corpus(spark, sf).where("content IS NOT NULL")
    rows = docs.select("document_id", F.posexplode(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")).alias("i", "l")).withColumn("l", F.trim("l")).where("l <> ''")
    kind = F.when(F.col("l").rlike("^# "), "h1").when(F.col("l").rlike("^## "), "h2").when(F.col("l").rlike("^#{3,} "), "h3").when(F.col("l").rlike("^[-*] "), "ul").when(F.col("l").rlike("^[0-9]+[.)] "), "ol").otherwise("p")
    w = Window.partitionBy("document_id").orderBy("i")
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumn("starts", F.when(F.col("kind").isin("ul", "ol") & (F.lag("kind").over(w) == F.col("kind")), 0).otherwise(1))
    return rows.withColumn("block", F.sum("starts").over(w)).groupBy("document_id", "block").agg(F.min("kind").alias("kind"), F.count("*").alias("n_lines"))
