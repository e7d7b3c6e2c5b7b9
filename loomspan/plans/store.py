"""Queries on graph, store, crawl and feedback tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import ids, urls
from loomspan.functions.shared import scratch
from loomspan.operators import crawl, graph, merging
from loomspan.plans.common import Plans, newest_corpus, table
from loomspan.plans.knowledge import NEWEST, urls_cte
from loomspan.sources import files, schemas
from loomspan.streaming import ingest

plans = Plans()
KEYS = schemas.KEYS

# --- graph ---------------------------------------------------------------------------------------

_NODE_ROWS = """rows AS (SELECT edge_id AS o, 0 AS side, source_id AS id, source_label AS label, source_type AS type, source_description AS description FROM graph_edges
 UNION ALL SELECT edge_id, 1, target_id, target_label, target_type, target_description FROM graph_edges)"""
_NODES = """nodes AS (SELECT id, coalesce(nullif(n.label, ''), id) AS label, coalesce(nullif(n.type, ''), 'Entity') AS type, coalesce(n.description, '') AS description
 FROM (SELECT id, {pick}({{'label': label, 'type': type, 'description': description}}, {{'o': o, 'side': side}}) AS n FROM rows WHERE coalesce(id, '') <> '' GROUP BY id))"""
_FIRST, _LAST = _NODES.format(pick="arg_min"), _NODES.format(pick="arg_max")
_LINKS = "links AS (SELECT DISTINCT source_id AS source, target_id AS target, coalesce(relation, '') AS relation FROM graph_edges WHERE coalesce(source_id, '') <> '' AND coalesce(target_id, '') <> '')"


def _distinct_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges by id: copies of a row are one (the newest counts)."""
    return merging.latest_by(table(spark, sf, "graph_edges").where("edge_id IS NOT NULL"), ["edge_id"], [F.desc("created_at"), F.desc_nulls_last("crawl_batch_id")])


_EDGES = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY created_at DESC, crawl_batch_id DESC NULLS LAST) AS rn FROM graph_edges WHERE edge_id IS NOT NULL) WHERE rn = 1)"
_E = "WITH e AS " + _EDGES + ", "


@plans.add((_E + _NODE_ROWS + ", " + _FIRST + " SELECT * FROM nodes").replace("FROM graph_edges", "FROM e").replace("(SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY created_at DESC, crawl_batch_id DESC NULLS LAST) AS rn FROM e ", "(SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY created_at DESC, crawl_batch_id DESC NULLS LAST) AS rn FROM graph_edges "))
def graph_full(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_nodes(_distinct_edges(spark, sf), "edge_id")


@plans.add((_E + _NODE_ROWS + ", " + _LAST + " SELECT * FROM nodes").replace("FROM graph_edges", "FROM e").replace("AS rn FROM e ", "AS rn FROM graph_edges "))
def graph_from_triples(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_nodes(_distinct_edges(spark, sf), "edge_id", last=True)


@plans.add("SELECT DISTINCT source_id AS source, target_id AS target, coalesce(relation, '') AS relation FROM graph_edges WHERE coalesce(source_id, '') <> '' AND coalesce(target_id, '') <> ''")
def graph_links(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_links(table(spark, sf, "graph_edges"))


def _fix(sql: str) -> str:
    return (_E + sql).replace("FROM graph_edges", "FROM e").replace("AS rn FROM e ", "AS rn FROM graph_edges ")


@plans.add(_fix(_NODE_ROWS + ", " + _FIRST + """, n2 AS (SELECT lower(id) AS k, arg_max({'label': label, 'type': type, 'description': description}, id) AS n FROM nodes GROUP BY lower(id)), """ + _LINKS + """
SELECT source, target, relation, coalesce(nullif(a.n.label, ''), source) AS source_label, coalesce(nullif(a.n.type, ''), 'Entity') AS source_type, coalesce(nullif(a.n.description, ''), '') AS source_description,
 coalesce(nullif(b.n.label, ''), target) AS target_label, coalesce(nullif(b.n.type, ''), 'Entity') AS target_type, coalesce(nullif(b.n.description, ''), '') AS target_description
FROM links LEFT JOIN n2 a ON lower(source) = a.k LEFT JOIN n2 b ON lower(target) = b.k"""))
def graph_edges_build(spark: SparkSession, sf: str) -> DataFrame:
    e = _distinct_edges(spark, sf)
    nodes = graph.graph_nodes(e, "edge_id").withColumn("pos", F.col("id"))
    return graph.edge_rows(graph.graph_links(e), nodes)


_SEARCH = "contains(lower(coalesce({c}, '')), k)"


def _search_sql(columns: list[str]) -> str:
    cond = " OR ".join(_SEARCH.replace("{c}", c) for c in columns)
    return f"SELECT DISTINCT source_id, relation, target_id, document_id FROM graph_edges WHERE EXISTS (SELECT 1 FROM (VALUES ('zakat'), ('wakaf'), ('riba'), ('kubur')) w(k) WHERE {cond})"


@plans.add(_search_sql(["source_id", "source_label", "relation", "target_id", "target_label"]))
def graph_search(spark: SparkSession, sf: str) -> DataFrame:
    hit = _lexical(spark, sf, ["zakat", "wakaf", "riba", "kubur"], False)
    return hit.select("source_id", "relation", "target_id", "document_id").distinct()


def _lexical(spark: SparkSession, sf: str, words: list[str], descriptions: bool) -> DataFrame:
    from loomspan.operators.retrieval import lexical_edges

    return lexical_edges(table(spark, sf, "graph_edges"), words, descriptions)


@plans.add("SELECT DISTINCT source_id, relation, target_id FROM graph_edges WHERE EXISTS (SELECT 1 FROM (VALUES ('zakat'), ('nikah')) w(k) WHERE " + " OR ".join(_SEARCH.replace("{c}", c) for c in ("source_id", "source_label", "relation", "target_id", "target_label", "source_description", "target_description")) + ") ORDER BY source_id, relation, target_id LIMIT 10")
def graph_memory_search(spark: SparkSession, sf: str) -> DataFrame:
    hit = _lexical(spark, sf, ["zakat", "nikah"], True).select("source_id", "relation", "target_id").distinct()
    return hit.orderBy("source_id", "relation", "target_id").limit(10)



@plans.add("""WITH half AS (SELECT g.*, b.batch_seq <= (SELECT max(batch_seq) // 2 FROM crawl_batches) AS old FROM graph_edges g JOIN (SELECT crawl_batch_id, min(batch_seq) AS batch_seq FROM crawl_batches GROUP BY 1) b USING (crawl_batch_id) WHERE edge_id IS NOT NULL),
l AS (SELECT DISTINCT old, source_id AS source, target_id AS target, coalesce(relation, '') AS relation FROM half WHERE coalesce(source_id, '') <> '' AND coalesce(target_id, '') <> ''),
n AS (SELECT lower(source) AS s, lower(target) AS t, upper(relation) AS r, min({'source': source, 'target': target, 'relation': relation}) AS x FROM l WHERE NOT old AND NOT EXISTS (SELECT 1 FROM l o WHERE o.old AND lower(o.source) = lower(l.source) AND lower(o.target) = lower(l.target) AND upper(o.relation) = upper(l.relation)) GROUP BY ALL)
SELECT source, target, relation FROM l WHERE old UNION ALL SELECT x.source, x.target, x.relation FROM n""")
def graph_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The links of the later half of the batches merged into those of the earlier half."""
    seq = table(spark, sf, "crawl_batches").where("crawl_batch_id IS NOT NULL").groupBy("crawl_batch_id").agg(F.min("batch_seq").alias("seq"))
    half = int(seq.agg(F.max("seq")).first()[0] or 0) // 2
    e = table(spark, sf, "graph_edges").where("edge_id IS NOT NULL").join(seq, "crawl_batch_id")
    return graph.merge_links(graph.graph_links(e.where(F.col("seq") <= half)), graph.graph_links(e.where(F.col("seq") > half)))


@plans.add(_fix(_LINKS + """, ends AS (SELECT source AS id FROM links UNION ALL SELECT target FROM links)
SELECT id, count(*) AS degree FROM ends GROUP BY id ORDER BY degree DESC, id LIMIT 12"""))
def degree_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = _distinct_edges(spark, sf)
    return graph.degrees(graph.graph_links(e), graph.graph_nodes(e, "edge_id")).orderBy(F.desc("degree"), "id").limit(12)


@plans.add("WITH x AS (SELECT document_id, unnest(CASE WHEN source_id = target_id THEN [source_id] ELSE [source_id, target_id] END) AS id, edge_id FROM graph_edges WHERE document_id IS NOT NULL) SELECT document_id, id, count(DISTINCT edge_id) AS n_links FROM x WHERE id IS NOT NULL GROUP BY document_id, id")
def node_link_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "graph_edges").where("document_id IS NOT NULL")
    ends = e.select("document_id", "edge_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id")).where("id IS NOT NULL")
    return ends.groupBy("document_id", "id").agg(F.count_distinct("edge_id").alias("n_links"))


@plans.add("SELECT DISTINCT unnest(['zakat', source_id, target_id]) AS id FROM graph_edges WHERE (source_id = 'zakat' OR target_id = 'zakat') AND coalesce(source_id, '') <> '' AND coalesce(target_id, '') <> ''")
def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbourhood(graph.graph_links(table(spark, sf, "graph_edges")), "zakat")


@plans.add(f"""WITH e AS (SELECT * FROM {_EDGES} WHERE document_id IS NOT NULL),
s AS (SELECT document_id, id, min({{'o': edge_id, 'side': side}}) AS place FROM (SELECT document_id, edge_id, 0 AS side, source_id AS id FROM e UNION ALL SELECT document_id, edge_id, 1, target_id FROM e) WHERE coalesce(id, '') <> '' GROUP BY document_id, id),
n AS (SELECT document_id, id FROM s QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY place, id) <= 8),
l AS (SELECT e.document_id, source_id AS source, target_id AS target, coalesce(relation, '') AS relation, min(edge_id) AS o FROM e JOIN n a ON a.document_id = e.document_id AND a.id = source_id JOIN n b ON b.document_id = e.document_id AND b.id = target_id GROUP BY ALL)
SELECT document_id, source, target, relation FROM l QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY o, source, target, relation) <= 8""")
def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight nodes of each document's graph and at most eight links between them."""
    return graph.snippet(_distinct_edges(spark, sf).where("document_id IS NOT NULL"), "document_id", "edge_id")


@plans.add("""WITH n AS (SELECT DISTINCT document_id, unnest([source_id || ':' || coalesce(source_type, 'Entity'), target_id || ':' || coalesce(target_type, 'Entity')]) AS x FROM graph_edges WHERE document_id IS NOT NULL AND source_id IS NOT NULL AND target_id IS NOT NULL AND relation IS NOT NULL),
l AS (SELECT DISTINCT document_id, source_id || ':' || relation || ':' || target_id AS x FROM graph_edges WHERE document_id IS NOT NULL AND source_id IS NOT NULL AND target_id IS NOT NULL AND relation IS NOT NULL)
SELECT document_id, a || '::' || b AS signature FROM (SELECT document_id, string_agg(x, '|' ORDER BY x) AS a FROM n GROUP BY 1) JOIN (SELECT document_id, string_agg(x, '|' ORDER BY x) AS b FROM l GROUP BY 1) USING (document_id)""")
def graph_signature(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "graph_edges").where("document_id IS NOT NULL AND source_id IS NOT NULL AND target_id IS NOT NULL AND relation IS NOT NULL")
    return graph.signatures(e, "document_id")


@plans.add("""WITH RECURSIVE l AS (SELECT DISTINCT source_id AS s, target_id AS t FROM graph_edges WHERE coalesce(source_id, '') <> '' AND coalesce(target_id, '') <> ''),
walk(id, depth) AS (SELECT 'zakat', 0 UNION SELECT l.t, walk.depth + 1 FROM walk JOIN l ON walk.id = l.s WHERE walk.depth < 2)
SELECT id, min(depth) AS depth FROM walk GROUP BY id""")
def bfs_discovery(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([("zakat",)], "id string")
    return graph.reached(graph.graph_links(table(spark, sf, "graph_edges")), seeds, 2)


@plans.add("""WITH n AS (SELECT DISTINCT document_id, unnest([source_id, target_id]) AS id FROM graph_edges WHERE document_id IS NOT NULL),
p AS (SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY document_id) AS c FROM n WHERE id IS NOT NULL)
SELECT document_id, id, CASE WHEN c = 2 THEN (CASE WHEN k = 0 THEN -110.0 ELSE 110.0 END) WHEN k = 0 THEN 0.0 ELSE round(178 * cos(2 * pi() * (k - 1) / (c - 1) - pi() / 2), 4) + 0.0 END AS x, CASE WHEN k = 0 OR c = 2 THEN 0.0 ELSE round(54 * sin(2 * pi() * (k - 1) / (c - 1) - pi() / 2), 4) + 0.0 END AS y FROM p""")
def circle_layout(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "graph_edges").where("document_id IS NOT NULL").select("document_id", F.explode(F.array("source_id", "target_id")).alias("id")).where("id IS NOT NULL").distinct()
    out = graph.ellipse_layout(n, "document_id", "id")
    return out.select("document_id", "id", (F.round("x", 4) + F.lit(0.0)).alias("x"), (F.round("y", 4) + F.lit(0.0)).alias("y"))


# --- store ---------------------------------------------------------------------------------------

#: Staged are the rows of the later half of the batches (by batch_seq), the target is what came before.
_HALF = "SELECT crawl_batch_id FROM crawl_batches WHERE batch_seq <= (SELECT max(batch_seq) / 2 FROM crawl_batches)"


def _sides(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, DataFrame]:
    batches = table(spark, sf, "crawl_batches")
    old = batches.join(batches.agg((F.max("batch_seq") / 2).alias("h")), F.col("batch_seq") <= F.col("h")).select("crawl_batch_id").distinct()
    rows = schemas.conform(table(spark, sf, name), name).where(F.col(schemas.KEYS[name]).isNotNull() & F.col("crawl_batch_id").isNotNull())
    return rows.join(old, "crawl_batch_id", "left_semi"), rows.join(old, "crawl_batch_id", "left_anti")


def merge_state(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    target, staged = {}, {}
    for name, key in schemas.KEYS.items():
        old, staged[name] = _sides(spark, sf, name)
        target[name] = merging.latest_by(old, [key], [F.desc("updated_at" if name == "corpus" else "created_at"), F.desc_nulls_last("content_hash")])
    return target, staged


def _side_sql(name: str, key: str, ts: str, old: bool) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ts} DESC NULLS LAST, content_hash DESC NULLS LAST) AS rn FROM {name} WHERE {key} IS NOT NULL AND crawl_batch_id IS NOT NULL AND crawl_batch_id {'' if old else 'NOT'} IN ({_HALF})) WHERE rn = 1)"


def _merged_sql(name: str, key: str, ts: str, keep_created: bool) -> str:
    created = "CASE WHEN s.{k} IS NULL OR {keep} THEN coalesce(t.created_at, s.created_at) ELSE s.created_at END".format(k=key, keep="true" if keep_created else "false")
    return f"SELECT coalesce(s.{key}, t.{key}) AS {key}, CASE WHEN s.{key} IS NULL THEN t.document_id ELSE s.document_id END AS document_id, CASE WHEN s.{key} IS NULL THEN t.content_hash ELSE s.content_hash END AS content_hash, {created} AS created_at FROM {_side_sql(name, key, ts, True)} t FULL JOIN {_side_sql(name, key, ts, False)} s ON t.{key} = s.{key}"


@plans.add("SELECT document_id, content_hash, created_at::TIMESTAMP AS created_at FROM (" + _merged_sql("corpus", "document_id", "updated_at", True).replace(", CASE WHEN s.document_id IS NULL THEN t.document_id ELSE s.document_id END AS document_id", "") + ")")
def upsert_corpus(spark: SparkSession, sf: str) -> DataFrame:
    target, staged = merge_state(spark, sf)
    docs = merging.latest_by(staged["corpus"], ["document_id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("content_hash")])
    return merging.upsert(target["corpus"], docs, "document_id", keep=("created_at",)).select("document_id", "content_hash", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


_RETIRE = "WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.document_id = m.document_id) OR EXISTS (SELECT 1 FROM d WHERE d.document_id = m.document_id AND d.content_hash = m.content_hash)"
_D = f"d AS {_side_sql('corpus', 'document_id', 'updated_at', False)}"


@plans.add(f"WITH {_D}, m AS {_side_sql('chunks', 'chunk_id', 'created_at', True)} SELECT chunk_id, document_id FROM m {_RETIRE}")
def retire_stale(spark: SparkSession, sf: str) -> DataFrame:
    target, staged = merge_state(spark, sf)
    docs = merging.latest_by(staged["corpus"], ["document_id"], [F.desc("updated_at"), F.desc_nulls_last("content_hash")])
    return merging.retire_stale(target["chunks"], docs).select("chunk_id", "document_id")


@plans.add(
    f"WITH {_D}, c AS ({_merged_sql('chunks', 'chunk_id', 'created_at', False)}), g AS ({_merged_sql('graph_edges', 'edge_id', 'created_at', False)}), k AS ({_merged_sql('corpus', 'document_id', 'updated_at', True).replace(', CASE WHEN s.document_id IS NULL THEN t.document_id ELSE s.document_id END AS document_id', '')})"
    f" SELECT 'corpus' AS name, document_id AS key FROM k UNION ALL SELECT 'chunks', chunk_id FROM c m {_RETIRE} UNION ALL SELECT 'graph_edges', edge_id FROM g m {_RETIRE}"
)
def staged_merge(spark: SparkSession, sf: str) -> DataFrame:
    out = merging.staged_merge(*merge_state(spark, sf))
    return merging.union_all([df.select(F.lit(n).alias("name"), F.col(schemas.KEYS[n]).alias("key")) for n, df in out.items()])


@plans.add(f"""WITH cand AS {_side_sql('corpus', 'document_id', 'updated_at', False)}, known AS {_side_sql('corpus', 'document_id', 'updated_at', True)}
SELECT c.document_id, CASE WHEN k.content_hash = c.content_hash THEN 'SKIPPED_UNCHANGED' WHEN k.content_hash IS NULL THEN 'NEW' ELSE 'CHANGED' END AS status FROM cand c LEFT JOIN known k ON c.document_id = k.document_id""")
def skip_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    target, staged = merge_state(spark, sf)
    cand = merging.latest_by(staged["corpus"], ["document_id"], [F.desc("updated_at"), F.desc_nulls_last("content_hash")])
    return merging.skip_unchanged(cand.select("document_id", "content_hash"), target["corpus"]).select("document_id", "status")


@plans.add("SELECT DISTINCT run_id, normalized_url, status FROM crawl_attempts WHERE run_id IS NOT NULL")
def attempts_append(spark: SparkSession, sf: str) -> DataFrame:
    """The attempts log appended twice: the second time adds nothing."""
    a = table(spark, sf, "crawl_attempts").where("run_id IS NOT NULL")
    keys = ["run_id", "normalized_url", "status"]
    once = merging.new_rows(a.select(*keys), a.limit(0), keys)
    return once.unionByName(merging.new_rows(a.select(*keys), once, keys))


_SHARD = "(row_number() OVER (ORDER BY chunk_id, created_at, document_id) - 1) // 500"


@plans.add(f"SELECT shard::BIGINT AS shard, count(*) AS n, min(chunk_id) AS first_id FROM (SELECT chunk_id, {_SHARD} AS shard FROM (SELECT chunk_id, min(created_at) AS created_at, min(document_id) AS document_id FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)) GROUP BY shard")
def shard_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min("created_at").alias("created_at"))
    return files.shard_numbers(c, ["chunk_id"], 500).groupBy("shard").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"))


@plans.add("SELECT event_id, rating, created_at::TIMESTAMP AS created_at FROM response_feedback WHERE event_id IS NOT NULL")
def jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The feedback table written as JSON lines in shards and read again in its schema."""
    folder = scratch(spark, "feedback")
    files.write_shards(table(spark, sf, "response_feedback"), folder, 500)
    return files.read_jsonl(spark, "response_feedback", [folder]).where("event_id IS NOT NULL").select("event_id", "rating", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


_DOC = """'---' || chr(10) || 'title: ' || {t} || chr(10) || 'url: ' || {u} || chr(10) || 'source: ' || {s} || chr(10) || 'links:' || chr(10) || coalesce(l, '') || chr(10) || '---'"""


def _yaml(c: str) -> str:
    return f"('\"' || replace(replace(coalesce({c}, ''), '\\', '\\\\'), '\"', '\\\"') || '\"')"


@plans.add(
    f"WITH {NEWEST}, e AS (SELECT document_id, list_sort(list(DISTINCT source_id || ' ' || relation || ' ' || target_id))[1:50] AS ls FROM graph_edges WHERE document_id IS NOT NULL GROUP BY document_id), f AS (SELECT document_id, array_to_string(list_transform(ls, lambda x: '  - \"' || replace(replace(x, '\\', '\\\\'), '\"', '\\\"') || '\"'), chr(10)) AS l FROM e)"
    f" SELECT document_id, {_DOC.replace('{t}', _yaml('title')).replace('{u}', _yaml('source_url')).replace('{s}', _yaml('source_name'))} AS document FROM newest LEFT JOIN f USING (document_id)"
)
def metadata_export(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "graph_edges").where("document_id IS NOT NULL AND source_id IS NOT NULL AND relation IS NOT NULL AND target_id IS NOT NULL")
    links = e.select("document_id", F.concat_ws(" ", "source_id", "relation", "target_id").alias("l")).groupBy("document_id").agg(F.array_sort(F.collect_set("l")).alias("links"))
    docs = newest_corpus(spark, sf).select("document_id", "title", "source_url", "source_name").join(links, "document_id", "left")
    return docs.select("document_id", files.metadata_document(F.col("title"), F.col("source_url"), F.col("source_name"), F.coalesce("links", F.array().cast("array<string>"))).alias("document"))


@plans.add("""WITH n AS (SELECT DISTINCT document_id, unnest([source_id, target_id]) AS id FROM graph_edges WHERE document_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id) AS place FROM n WHERE id IS NOT NULL)
SELECT document_id, id, place::INTEGER AS place, 'doc.' || substr(sha256(document_id), 1, 12) || '.' || id AS entry FROM r WHERE place <= 25""")
def catalog_entries(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "graph_edges").where("document_id IS NOT NULL").select("document_id", F.explode(F.array("source_id", "target_id")).alias("id")).where("id IS NOT NULL").distinct()
    r = n.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("id"))).where("place <= 25")
    return r.withColumn("entry", F.concat(F.lit("doc."), ids.hex_id(F.col("document_id"), 12), F.lit("."), F.col("id")))


# --- crawl ---------------------------------------------------------------------------------------


@plans.add("SELECT source_id, run_id, status, updated_at::TIMESTAMP AS updated_at FROM crawl_runs WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, created_at DESC, event_id DESC) = 1")
def latest_run_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.latest_runs(table(spark, sf, "crawl_runs")).select("source_id", "run_id", "status", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


def _stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The same through a file stream: batches fold into versioned tables of the newest row a source."""
    place = scratch(spark, "stream")
    stream = ingest.read_folder(spark, sf, schemas.TABLES["crawl_runs"], glob="crawl_runs.parquet").where("source_id IS NOT NULL") if not _is_folder(spark, f"{sf}/crawl_runs.parquet") else ingest.read_folder(spark, f"{sf}/crawl_runs.parquet", schemas.TABLES["crawl_runs"]).where("source_id IS NOT NULL")
    keys, order = ["source_id"], ["updated_at", "created_at", "event_id"]
    ingest.start(stream, ingest.keep_latest(f"{place}/t", keys, order), f"{place}/c").awaitTermination()
    rows = ingest.latest(spark, f"{place}/t", keys, order)
    rows = spark.createDataFrame([], schemas.schema("crawl_runs")) if rows is None else rows
    return rows.select("source_id", "run_id", "status", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


plans.put("stream_ingest", _stream_latest, plans.sql["latest_run_per_source"])

HOST = "regexp_replace(regexp_extract(lower(coalesce({c}, '')), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '^www\\.', '')"


@plans.add(f"""WITH pages AS (SELECT source_url, source_name, max({{'updated_at': updated_at, 'title': title}}) AS m, count(DISTINCT document_id) AS n FROM corpus WHERE source_url IS NOT NULL GROUP BY ALL),
j AS (SELECT s.id AS source_id, n, m FROM pages p JOIN crawl_sources s ON p.source_name = s.name OR suffix({HOST.replace('{c}', 'p.source_url')}, {HOST.replace('{c}', 's.url')}))
SELECT source_id, sum(n)::BIGINT AS pages, max(m.updated_at)::TIMESTAMP AS last_updated FROM j GROUP BY source_id""")
def infer_crawl_status(spark: SparkSession, sf: str) -> DataFrame:
    out = crawl.attributed(table(spark, sf, "corpus"), table(spark, sf, "crawl_sources"))
    return out.select("source_id", "pages", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


@plans.add("""SELECT run_id, (SELECT count(*) FROM corpus c WHERE c.crawl_batch_id = r.run_id) AS n_documents, (SELECT count(*) FROM chunks c WHERE c.crawl_batch_id = r.run_id) AS n_chunks, (SELECT count(*) FROM graph_edges c WHERE c.crawl_batch_id = r.run_id) AS n_edges,
 strftime(started, '%H:%M') AS started FROM (SELECT run_id, min(created_at) + INTERVAL 8 HOUR AS started FROM crawl_runs WHERE run_id IS NOT NULL GROUP BY run_id) r""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "crawl_runs").where("run_id IS NOT NULL").groupBy("run_id").agg(F.min("created_at").alias("t"))
    for name, out in (("corpus", "n_documents"), ("chunks", "n_chunks"), ("graph_edges", "n_edges")):
        n = table(spark, sf, name).groupBy(F.col("crawl_batch_id").alias("run_id")).agg(F.count("*").alias(out))
        runs = runs.join(n, "run_id", "left").na.fill(0, [out])
    return runs.select("run_id", "n_documents", "n_chunks", "n_edges", F.date_format(F.from_utc_timestamp(F.to_utc_timestamp("t", F.current_timezone()), "Asia/Kuala_Lumpur"), "HH:mm").alias("started"))


@plans.add("""WITH u AS (SELECT source_name, normalized_url, bool_or(status <> 'DISCOVERED') AS tried, bool_or(status IN ('PREPARED', 'CATALOGED')) AS good, bool_or(status = 'SKIPPED_UNCHANGED') AS same, bool_or(status = 'FAILED') AS bad FROM crawl_attempts GROUP BY ALL)
SELECT source_name, count(*) AS discovered, count(*) FILTER (tried) AS tried, count(*) FILTER (good) AS good, count(*) FILTER (same) AS same, count(*) FILTER (bad) AS bad, round(100.0 * count(*) FILTER (tried) / count(*), 2)::DOUBLE AS coverage FROM u GROUP BY source_name""")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.completeness(table(spark, sf, "crawl_attempts"))


@plans.add("SELECT run_id, count(*) AS total, count(*) FILTER (status IN ('SUCCESS', 'FAILED')) AS completed, count(*) FILTER (status = 'SUCCESS') AS succeeded, count(*) FILTER (status = 'FAILED') AS failed, min(url) FILTER (status = 'RUNNING') AS running_url, floor(100 * (count(*) FILTER (status IN ('SUCCESS', 'FAILED'))) / count(*) + 0.5)::BIGINT AS percent FROM crawl_runs GROUP BY run_id")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.progress(table(spark, sf, "crawl_runs"))


@plans.add("""WITH s AS (SELECT DISTINCT event_id, list_filter([gcs_status, bigquery_status, knowledge_catalog_status], lambda x: x <> 'SKIPPED_NOT_CONFIGURED') AS r FROM crawl_runs WHERE gcs_status IS NOT NULL AND bigquery_status IS NOT NULL AND knowledge_catalog_status IS NOT NULL)
SELECT event_id, CASE WHEN len(r) = 0 THEN 'SKIPPED_NOT_CONFIGURED' WHEN len(list_filter(r, lambda x: x = 'SUCCESS')) = len(r) THEN 'SUCCESS' WHEN len(list_filter(r, lambda x: x = 'SUCCESS')) > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM s""")
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    names = ["gcs_status", "bigquery_status", "knowledge_catalog_status"]
    r = table(spark, sf, "crawl_runs").na.drop(subset=names)
    return r.select("event_id", crawl.rolled_up(F.array(*names)).alias("status"), *names).distinct().select("event_id", "status").distinct()


@plans.add(f"""WITH l AS (SELECT url, max({{'updated_at': updated_at, 'event_id': event_id, 'status': status}}) AS m FROM crawl_runs WHERE url IS NOT NULL GROUP BY url)
SELECT s.url AS portal_url, (max(m)).status AS status, (max(m)).updated_at::TIMESTAMP AS updated_at FROM crawl_sources s LEFT JOIN l ON starts_with(regexp_replace(l.url, '/$', ''), regexp_replace(s.url, '/$', '')) GROUP BY s.url""")
def portal_status(spark: SparkSession, sf: str) -> DataFrame:
    portals = table(spark, sf, "crawl_sources").select(F.col("url").alias("portal_url"))
    out = crawl.prefixed(portals, table(spark, sf, "crawl_runs").where("url IS NOT NULL"))
    return out.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@plans.add(f"""WITH {urls_cte('crawl_attempts', 'url')}, a AS (SELECT canonical, source_id, url, row_number() OVER (ORDER BY url, source_id) AS pos FROM (SELECT DISTINCT url, source_id FROM crawl_attempts WHERE source_id IS NOT NULL AND url IS NOT NULL) JOIN url_map ON url = u)
SELECT canonical AS normalized_url, arg_max(source_id, pos) AS source_id FROM a WHERE canonical <> '' GROUP BY canonical""")
def candidate_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "crawl_attempts").where("source_id IS NOT NULL AND url IS NOT NULL").select("url", "source_id").distinct()
    return crawl.unique_candidates(a.withColumn("pos", F.struct("url", "source_id"))).select("normalized_url", "source_id")


@plans.add(f"""SELECT DISTINCT a.source_id, a.url FROM crawl_attempts a JOIN crawl_sources s ON a.source_id = s.id
WHERE {HOST.replace('{c}', 'a.url')} = {HOST.replace('{c}', 's.url')} AND len(list_filter(s.include_patterns, lambda p: a.url LIKE replace(p, '*', '%'))) > 0""")
def url_filters(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "crawl_attempts").select("source_id", "url").distinct()
    return crawl.allowed(a, table(spark, sf, "crawl_sources"))


@plans.add("""WITH r AS (SELECT DISTINCT crawl_batch_id, document_id, title, crawler, length(content) AS n FROM corpus WHERE crawl_batch_id IS NOT NULL)
SELECT crawl_batch_id, count(DISTINCT document_id) AS n_documents, coalesce(sum(n), 0)::BIGINT AS characters, (SELECT title FROM r f WHERE f.crawl_batch_id = r.crawl_batch_id AND title IS NOT NULL ORDER BY document_id, title LIMIT 1) AS first_title, (SELECT coalesce(string_agg(crawler, '+' ORDER BY seen, crawler), '') FROM (SELECT crawler, min(document_id) AS seen FROM r f WHERE f.crawl_batch_id = r.crawl_batch_id AND crawler IS NOT NULL GROUP BY crawler)) AS crawlers FROM r GROUP BY crawl_batch_id""")
def batch_totals(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.batch_totals(table(spark, sf, "corpus"))


# --- feedback, events ----------------------------------------------------------------------------


@plans.add("WITH f AS (SELECT DISTINCT event_id, rating FROM response_feedback) SELECT count(*) AS total, count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down, floor(100.0 * (count(*) FILTER (rating = 'down')) / count(*) + 0.5)::BIGINT AS down_rate FROM f")
def feedback_analytics(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "response_feedback").select("event_id", "rating").distinct()
    out = f.agg(F.count("*").alias("total"), F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"))
    return out.withColumn("down_rate", F.coalesce(F.floor(F.try_divide(100.0 * F.col("down"), F.col("total")) + 0.5), F.lit(0)).cast("long"))


@plans.add("SELECT message_id, rating, event_id FROM response_feedback WHERE message_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY created_at DESC, event_id DESC) = 1")
def feedback_latest(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "response_feedback").where("message_id IS NOT NULL")
    return merging.latest_by(f, ["message_id"], [F.desc("created_at"), F.desc("event_id")]).select("message_id", "rating", "event_id")


@plans.add("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events")
def previous_turn(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", crawl.turns(e, "user_id", ["ts", "event_id"], F.col("event_type") == "view", F.col("value")).alias("last_view"))


@plans.add("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 6")
def history_window(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 6").select("user_id", "event_id")


@plans.add("WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS starts FROM events), g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM s) SELECT user_id, min(ts) AS started, count(*) AS n_events, max(ts) + INTERVAL 1 DAY AS expires FROM g GROUP BY user_id, n")
def session_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that end a day after their last event."""
    s = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n_events"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n_events", F.col("w.end").cast("timestamp_ntz").alias("expires"))


@plans.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = ingest.windowed_counts(table(spark, sf, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def cache_replay(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("scope"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("key"))
    return ingest.lru_replay(e.withColumn("at", F.unix_micros("at") / 1e6), 250, 86_400)


#: The log replayed row by row: the cache is a list, what was used longest ago comes first.
_REPLAY = """WITH RECURSIVE e AS (SELECT event_type AS scope, epoch_us(ts) / 1e6 AS at_s, user_id AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts, user_id) AS i FROM events),
c AS (SELECT scope, 0::BIGINT AS i, []::STRUCT(k BIGINT, t DOUBLE)[] AS l, 0::BIGINT AS hits, 0::BIGINT AS misses, 0::BIGINT AS evictions FROM (SELECT DISTINCT scope FROM e) UNION ALL
 SELECT scope, i, CASE WHEN hit THEN list_append(rest, {'k': key, 't': told}) WHEN len(rest) >= 250 THEN list_append(rest[2:], {'k': key, 't': at_s}) ELSE list_append(rest, {'k': key, 't': at_s}) END,
  hits + hit::BIGINT, misses + (NOT hit)::BIGINT, evictions + (CASE WHEN hit THEN 0 ELSE (told IS NOT NULL)::BIGINT + (len(rest) >= 250)::BIGINT END)
 FROM (SELECT c.scope, e.i, e.key, e.at_s, hits, misses, evictions, list_filter(l, lambda x: x.k <> e.key) AS rest, list_filter(l, lambda x: x.k = e.key)[1].t AS told, coalesce(e.at_s - list_filter(l, lambda x: x.k = e.key)[1].t <= 86400, false) AS hit FROM c JOIN e ON e.scope = c.scope AND e.i = c.i + 1))
SELECT scope, hits, misses, misses AS sets, evictions, len(l)::BIGINT AS size FROM c QUALIFY row_number() OVER (PARTITION BY scope ORDER BY i DESC) = 1"""
plans.put("cache_replay", cache_replay, _REPLAY)


@plans.add(f"WITH {NEWEST}, {urls_cte('corpus', 'source_url')} SELECT 'normalized:' || sha256(canonical) AS cache_key, count(*) AS n FROM newest JOIN url_map ON source_url = u GROUP BY 1")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = newest_corpus(spark, sf).where("source_url IS NOT NULL")
    return c.groupBy(ids.cache_key("normalized", urls.normalize_url(F.col("source_url"))).alias("cache_key")).agg(F.count("*").alias("n"))
