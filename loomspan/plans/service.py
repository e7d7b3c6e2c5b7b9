"""Queries on feedback records, sessions, crawl states, model calls and published versions, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import models, text, urls
from loomspan.functions.partitions import bounded
from loomspan.functions.shared import scratch
from loomspan.operators import crawl, feedback, graph, merging, retrieval, sessions
from loomspan.plans import store
from loomspan.plans.common import Plans, table
from loomspan.plans.knowledge import norm, urls_cte
from loomspan.sources import files
from loomspan.sources.versions import Versions
from loomspan.streaming import ingest

plans = Plans()

# --- feedback ------------------------------------------------------------------------------------

_EVENTS = """ev AS (SELECT DISTINCT event_id, message_id, user_agent, rating, substr(coalesce(prompt, ''), 1, 6000) AS question, substr(coalesce(response, ''), 1, 12000) AS answer,
 CASE WHEN rating = 'down' THEN substr(coalesce(prompt, ''), 1, 4000) ELSE '' END AS comment, CASE WHEN json_valid(citations_json) AND json_type(citations_json) = 'ARRAY' THEN len(list_filter(from_json(citations_json, '[{"url":"VARCHAR"}]'), lambda x: x.url IS NOT NULL)) END AS n_c,
 {'a': created_at, 'b': event_id} AS o FROM response_feedback WHERE message_id IS NOT NULL)"""
_RECORDS = f"""{_EVENTS}, rec AS (SELECT user_agent, message_id, CASE WHEN arg_max(rating, o) FILTER (rating IS NOT NULL) = 'up' THEN 'up' ELSE 'down' END AS rating,
 coalesce(arg_max(question, o) FILTER (question <> ''), '') AS question, coalesce(arg_max(answer, o) FILTER (answer <> ''), '') AS answer, coalesce(arg_max(comment, o) FILTER (comment <> ''), '') AS comment,
 least(coalesce(arg_max(n_c, o) FILTER (n_c IS NOT NULL), 0), 20) AS n_citations, count(DISTINCT event_id) AS n_events FROM ev GROUP BY user_agent, message_id),
records AS (SELECT *, 'new' AS review_status, CASE WHEN rating = 'down' AND trim(comment) <> '' THEN 'queued' ELSE 'none' END AS pipeline_status FROM rec)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "response_feedback").where("message_id IS NOT NULL").distinct()
    e = e.withColumns({"question": F.col("prompt"), "answer": F.col("response"), "comment": F.when(F.col("rating") == "down", F.col("prompt")), "citations": F.from_json("citations_json", "array<struct<title:string,url:string>>")})
    return feedback.folded(e, ["user_agent", "message_id"])


@plans.add(f"WITH {_RECORDS} SELECT user_agent, message_id, rating, question, answer, comment, n_citations::INTEGER AS n_citations, n_events, review_status, pipeline_status FROM records")
def feedback_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events put in one after the other, over the record of the same session and message."""
    return _records(spark, sf).select("user_agent", "message_id", "rating", "question", "answer", "comment", F.size("citations").alias("n_citations"), "n_events", "review_status", "pipeline_status")


_PATCHED = f"""{_RECORDS}, patched AS (SELECT user_agent || '/' || message_id AS id, rating, CASE WHEN length(message_id) % 2 = 0 THEN 'resolved' ELSE review_status END AS review_status,
 CASE WHEN rating = 'up' THEN 'applied' ELSE pipeline_status END AS pipeline_status, substr(question, 1, 40) AS reviewer_note FROM records WHERE user_agent IS NOT NULL)"""


def _patched(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf).where("user_agent IS NOT NULL").withColumns({"id": F.concat_ws("/", "user_agent", "message_id"), "reviewer_note": F.lit(""), "improvement_plan": F.lit("")})
    patch = records.select("id", F.when(F.length("message_id") % 2 == 0, "resolved").otherwise("no such state").alias("review_status"), F.substring("question", 1, 40).alias("reviewer_note"), F.when(F.col("rating") == "up", "applied").alias("pipeline_status"), F.lit("").alias("improvement_plan"))
    return feedback.patched(records, patch, "id")


@plans.add(f"WITH {_PATCHED} SELECT id, review_status, pipeline_status, reviewer_note FROM patched")
def feedback_patched(spark: SparkSession, sf: str) -> DataFrame:
    return _patched(spark, sf).select("id", "review_status", "pipeline_status", "reviewer_note")


@plans.add(f"WITH {_PATCHED} SELECT id, CASE WHEN review_status = 'new' THEN 'reviewing' ELSE review_status END AS review_status, 'drafted' AS pipeline_status, 'Plan: ' || reviewer_note AS improvement_plan FROM patched")
def feedback_drafted(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.drafted(_patched(spark, sf), F.concat(F.lit("Plan: "), F.col("reviewer_note"))).select("id", "review_status", "pipeline_status", "improvement_plan")


@plans.add(f"""WITH {_RECORDS} SELECT count(*) AS total, count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down, count(*) FILTER (review_status = 'new') AS new, count(*) FILTER (pipeline_status = 'queued') AS queued, count(*) FILTER (pipeline_status = 'drafted') AS drafted,
 coalesce(floor(100.0 * (count(*) FILTER (rating = 'down')) / count(*) + 0.5), 0)::BIGINT AS down_rate FROM records""")
def feedback_counts(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.counts(_records(spark, sf))


@plans.add("SELECT DISTINCT event_id, rating FROM (SELECT DISTINCT event_id, rating, created_at FROM response_feedback ORDER BY created_at DESC, event_id DESC LIMIT 500)")
def feedback_newest(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept in memory of an event log: the newest 500."""
    e = table(spark, sf, "response_feedback").select("event_id", "rating", "created_at").distinct()
    return e.orderBy(F.desc("created_at"), F.desc("event_id")).limit(500).select("event_id", "rating")


# --- sessions ------------------------------------------------------------------------------------


@plans.add("""WITH m AS (SELECT user_id, event_id, {'ts': ts, 'id': event_id} AS o, CASE WHEN event_id % 7 <> 0 THEN repeat(event_type, 3) END AS content, CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'system' ELSE 'model' END AS role,
 CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2000-01-01' ELSE date_trunc('second', ts) END AS t FROM events WHERE user_id IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o DESC) AS back FROM m)
SELECT user_id, string_agg(event_id || ' ' || role || ' ' || content || ' ' || strftime(t, '%Y-%m-%d %H:%M:%S'), '|' ORDER BY o) AS messages FROM l WHERE back <= 80 AND content IS NOT NULL GROUP BY user_id""")
def session_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as chat messages, of which some have no content, an unknown role or a broken time."""
    role = F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "click", "system").otherwise(F.col("event_type"))
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    m = F.struct(F.col("event_id").cast("string").alias("id"), role.alias("role"), F.when(F.col("event_id") % 7 != 0, F.repeat("event_type", 3)).alias("content"), F.when(F.col("event_id") % 5 == 0, "soon").otherwise(ts).alias("timestamp"))
    e = table(spark, sf, "events").where("user_id IS NOT NULL").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", m.alias("m"))))["m"].alias("m"))
    clean = sessions.messages(F.col("m"), F.lit("2000-01-01").cast("timestamp"))
    said = F.transform(clean, lambda x: F.concat_ws(" ", x["id"], x["role"], x["content"], F.date_format(x["timestamp"], "yyyy-MM-dd HH:mm:ss")))
    return e.select("user_id", F.array_join(said, "|").alias("messages")).where("messages <> ''")


@plans.add("""WITH n AS (SELECT document_id, id, min(t) AS t FROM (SELECT document_id, source_id AS id, source_type AS t FROM graph_edges UNION ALL SELECT document_id, target_id, target_type FROM graph_edges) WHERE document_id IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id, t) AS rn FROM n WHERE id IS NOT NULL), top AS (SELECT * FROM k WHERE rn <= 80),
l AS (SELECT DISTINCT e.document_id, source_id, target_id, coalesce(relation, '') AS relation FROM graph_edges e JOIN top a ON a.document_id = e.document_id AND a.id = source_id JOIN top b ON b.document_id = e.document_id AND b.id = target_id),
x AS (SELECT document_id, count(*) AS n FROM l GROUP BY document_id)
SELECT document_id, string_agg(substr(id, 1, 120) || ':' || coalesce(nullif(substr(coalesce(t, ''), 1, 40), ''), 'Entity'), '|' ORDER BY id) AS nodes, least(coalesce(any_value(x.n), 0), 160) AS n_links FROM top LEFT JOIN x USING (document_id) GROUP BY document_id""")
def graph_sanitised(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "graph_edges").where("document_id IS NOT NULL")
    ends = F.array(*[F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_type").alias("type")) for s in ("source", "target")])
    n = e.select("document_id", F.explode(ends).alias("n")).groupBy("document_id", F.col("n.id").alias("id")).agg(F.min("n.type").alias("type"))
    n = n.groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct("id", "type", F.lit("").alias("label"), F.lit("").alias("description")))).alias("nodes"))
    links = e.select("document_id", F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.coalesce("relation", F.lit("")).alias("relation")).alias("l")).distinct().groupBy("document_id").agg(F.array_sort(F.collect_list("l")).alias("links"))
    out = n.join(links, "document_id").select("document_id", sessions.graph_parts(F.col("nodes"), F.col("links")).alias("g"))
    return out.select("document_id", F.array_join(F.transform("g.nodes", lambda x: F.concat_ws(":", x["id"], x["type"])), "|").alias("nodes"), F.size("g.links").cast("long").alias("n_links")).where("nodes <> ''")


@plans.add("""WITH a AS (SELECT user_agent AS session, arg_max(rating, {'a': created_at, 'b': event_id}) AS tab FROM response_feedback WHERE user_agent IS NOT NULL GROUP BY 1)
SELECT session, CASE WHEN length(session) % 2 = 0 THEN 'graph' ELSE 'chat' END AS active_tab, CASE WHEN tab = 'up' THEN 'typed' ELSE 'old' END AS user_input FROM a""")
def session_patched(spark: SparkSession, sf: str) -> DataFrame:
    """A patch overwrites only what is valid in it."""
    newest = F.max_by("rating", F.struct("created_at", "event_id"))
    s = table(spark, sf, "response_feedback").where("user_agent IS NOT NULL").groupBy(F.col("user_agent").alias("session")).agg(newest.alias("rating"))
    state = s.select("session", F.lit("chat").alias("active_tab"), F.lit("old").alias("user_input"))
    patch = s.select("session", F.when(F.length("session") % 2 == 0, "graph").otherwise("no such tab").alias("active_tab"), F.when(F.col("rating") == "up", "typed").alias("user_input"))
    return sessions.patched(state, patch, "session", {"active_tab": sessions.one_of(F.col("active_tab"), sessions.TABS), "user_input": F.substring("user_input", 1, sessions.INPUT_LENGTH)})


@plans.add("SELECT DISTINCT event_id, CASE WHEN regexp_full_match(event_id, '[a-zA-Z0-9-]{20,80}') AND rating = 'up' THEN event_id ELSE 'fresh' END AS session FROM response_feedback WHERE event_id IS NOT NULL")
def session_ids(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "response_feedback").where("event_id IS NOT NULL").select("event_id", F.when(F.col("rating") == "up", F.col("event_id")).otherwise("!").alias("cookie")).distinct()
    return e.select("event_id", sessions.session_id(F.col("cookie"), F.lit("fresh")).alias("session"))


_TURNS = f"list_transform(list_slice(h, greatest(len(h) - 5, 1), len(h)), lambda x: x.role || ':' || substr({norm('x.content')}, 1, 2000))"


@plans.add(f"""WITH p AS (SELECT DISTINCT message_id, event_id, created_at, prompt, response FROM response_feedback WHERE message_id IS NOT NULL),
h AS (SELECT message_id, list({{'role': 'user', 'content': coalesce(prompt, '')}} ORDER BY created_at, event_id) AS h FROM p GROUP BY message_id)
SELECT p.event_id, CASE WHEN length(coalesce(prompt, '')) <= 1000 THEN 'chat-response:' || sha256(concat_ws(chr(10), '1', '3', 'm', {norm("coalesce(prompt, '')")}, array_to_string({_TURNS}, '|'))) END AS key FROM p JOIN h USING (message_id)""")
def answer_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "response_feedback").where("message_id IS NOT NULL").select("message_id", "event_id", "created_at", "prompt", "response").distinct()
    turn = F.struct(F.lit("user").alias("role"), F.coalesce("prompt", F.lit("")).alias("content"))
    h = p.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "event_id", turn.alias("t"))))["t"].alias("h"))
    return p.join(h, "message_id").select("event_id", sessions.answer_key(F.col("prompt"), F.col("h"), F.lit(3), F.lit("m")).alias("key"))


@plans.add("""WITH f AS (SELECT message_id, max(event_id) FILTER (rating = 'up') AS a, max(event_id) FILTER (rating = 'down') AS b FROM response_feedback WHERE message_id IS NOT NULL GROUP BY 1)
SELECT message_id, coalesce(a, b) AS event_id, CASE WHEN a IS NOT NULL THEN 'local' WHEN b IS NOT NULL THEN 'shared' ELSE 'compute' END AS tier FROM f""")
def tiered_lookup(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "response_feedback").where("message_id IS NOT NULL").select("message_id", "event_id", "rating")
    old = f.withColumn("version", F.lit(1)).withColumn("event_id", F.lit("zzz"))  # stale: another version of the knowledge
    tiers = [f.where(F.col("rating") == r).withColumn("version", F.lit(2)).unionByName(old) for r in ("up", "down")]
    return sessions.two_tiers(f, tiers[0].drop("rating"), tiers[1].drop("rating"), "message_id", "event_id", 2)


# --- crawl ---------------------------------------------------------------------------------------


@plans.add(f"""WITH {urls_cte('corpus', 'source_url')}, c AS (SELECT crawl_batch_id, document_id, canonical FROM (SELECT DISTINCT crawl_batch_id, document_id, source_url FROM corpus WHERE crawl_batch_id IS NOT NULL AND source_url IS NOT NULL) JOIN url_map ON source_url = u WHERE canonical <> ''),
f AS (SELECT crawl_batch_id, canonical, min(document_id) AS document_id FROM c GROUP BY ALL)
SELECT crawl_batch_id, canonical AS normalized_url, document_id, row_number() OVER (PARTITION BY crawl_batch_id ORDER BY document_id, canonical)::INTEGER AS place FROM f QUALIFY place <= 50""")
def unique_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 documents of each crawl, one for each normalised URL."""
    c = table(spark, sf, "corpus").where("crawl_batch_id IS NOT NULL").select("crawl_batch_id", "document_id", "source_url").distinct()
    return crawl.unique_documents(c, "crawl_batch_id", "document_id", 50).select("crawl_batch_id", "normalized_url", "document_id", "place")


@plans.add("SELECT crawl_batch_id, (sum(n - 1))::BIGINT AS n_seen FROM (SELECT crawl_batch_id, document_id, content_hash, count(*) AS n FROM corpus WHERE content_hash IS NOT NULL GROUP BY ALL) GROUP BY crawl_batch_id HAVING sum(n - 1) > 0")
def in_run_repeats(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "corpus").select("crawl_batch_id", "document_id", "content_hash", "updated_at")
    return crawl.in_run_repeats(c, "updated_at").where("seen").groupBy("crawl_batch_id").agg(F.count("*").alias("n_seen"))


_RANK = "coalesce(list_position(['" + "', '".join(crawl.STATES) + "'], status), 0)"


@plans.add(f"WITH a AS (SELECT run_id, normalized_url, max({{'u': updated_at, 'r': {_RANK}, 's': status, 'd': document_id}}) AS m, count(DISTINCT status) AS n_states FROM crawl_attempts WHERE run_id IS NOT NULL AND normalized_url IS NOT NULL GROUP BY ALL) SELECT run_id, normalized_url, m.s AS status, m.d AS document_id, n_states FROM a")
def attempt_states(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.attempt_states(table(spark, sf, "crawl_attempts"))


@plans.add("SELECT DISTINCT event_id, CASE WHEN status IN ('FAILED', 'RUNNING') THEN status ELSE 'SUCCESS' END AS status, coalesce(gcs_status, '') <> '' AND NOT starts_with(upper(gcs_status), 'SKIPPED') AND NOT contains(upper(gcs_status), 'NOT_CONFIGURED') AS stored FROM crawl_runs WHERE event_id IS NOT NULL")
def log_states(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawl_runs").where("event_id IS NOT NULL").select("event_id", crawl.log_status(F.col("status")).alias("status"), crawl.stored(F.col("gcs_status")).alias("stored")).distinct()


@plans.add("SELECT id, greatest(least(coalesce(nullif(default_max_pages, 0), 3), 3), 1) AS own, greatest(coalesce(nullif(id % 3, 0), greatest(least(coalesce(nullif(default_max_pages, 0), 3), 3), 1)), 1) AS asked FROM crawl_sources")
def page_caps(spark: SparkSession, sf: str) -> DataFrame:
    cap = F.col("default_max_pages")
    return table(spark, sf, "crawl_sources").select("id", crawl.page_cap(cap).alias("own"), crawl.page_cap(cap, F.col("id") % 3).alias("asked"))


@plans.add("""WITH n AS (SELECT document_id, max(crawler) AS crawler, bool_or(title IS NULL) AS untitled FROM corpus WHERE document_id IS NOT NULL GROUP BY 1) SELECT document_id, CASE WHEN untitled THEN 'secondary' ELSE 'primary' END AS crawler FROM n""")
def crawler_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the primary crawler has no title for come from the secondary one."""
    c = table(spark, sf, "corpus").where("document_id IS NOT NULL").groupBy("document_id").agg(F.bool_or(F.col("title").isNull()).alias("untitled"))
    primary, every = c.where("NOT untitled"), c.select("document_id", F.lit("secondary").alias("crawler"))
    return crawl.either(primary.select("document_id", F.lit("primary").alias("crawler")), every, "document_id")


@plans.add("""WITH r AS (SELECT run_id, min(created_at) + INTERVAL 8 HOUR AS t, bool_or(status = 'FAILED') AS bad FROM crawl_runs WHERE run_id IS NOT NULL GROUP BY run_id), c AS (SELECT crawl_batch_id AS run_id, count(*) AS n FROM corpus GROUP BY 1)
SELECT substr(sha256(run_id), 1, 32) AS event_id, run_id, 'Run ' || run_id || ': ' || coalesce(n, 0) || ' documents' AS log, CASE WHEN bad THEN 'FAILED' ELSE 'SUCCESS' END AS status, strftime(t, '%H:%M') AS display_time FROM r LEFT JOIN c USING (run_id)""")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """One summary row a run, appended to the log and read again; its id is made of the run, so that a rerun adds nothing."""
    runs = table(spark, sf, "crawl_runs").where("run_id IS NOT NULL").groupBy("run_id").agg(F.min("created_at").alias("t"), F.bool_or(F.col("status") == "FAILED").alias("bad"))
    n = table(spark, sf, "corpus").groupBy(F.col("crawl_batch_id").alias("run_id")).agg(F.count("*").alias("n"))
    local = F.from_utc_timestamp(F.to_utc_timestamp("t", F.current_timezone()), "Asia/Kuala_Lumpur")
    text = F.concat(F.lit("Run "), "run_id", F.lit(": "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" documents"))
    rows = runs.join(n, "run_id", "left").select(F.substring(F.sha2("run_id", 256), 1, 32).alias("event_id"), "run_id", text.alias("log"), F.when(F.col("bad"), "FAILED").otherwise("SUCCESS").alias("status"), F.date_format(local, "HH:mm").alias("display_time"))
    log = Versions(spark, scratch(spark, "log"))
    for _ in range(2):
        held = log.table("log")
        log.put("log", rows if held is None else merging.new_rows(rows, held, ["event_id"]))
        log.commit()
    return log.table("log")


# --- graph, models, versions ---------------------------------------------------------------------


@plans.add("""WITH l AS (SELECT DISTINCT lower(source_id) AS s, lower(target_id) AS t, document_id FROM graph_edges WHERE coalesce(source_id, '') <> '' AND coalesce(target_id, '') <> ''), n AS (SELECT lower(source_id) AS k, min({'o': edge_id, 'label': source_label}) AS m FROM graph_edges WHERE coalesce(source_id, '') <> '' AND edge_id IS NOT NULL GROUP BY 1)
SELECT document_id, s AS source, t AS target, a.m.label AS source_label, b.m.label AS target_label FROM l JOIN n a ON s = a.k JOIN n b ON t = b.k""")
def linked_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Links whose both ends are known as nodes, without regard to case; of several nodes the first counts."""
    e = table(spark, sf, "graph_edges").where("coalesce(source_id, '') <> ''")
    n = e.where("edge_id IS NOT NULL").groupBy(F.lower("source_id").alias("k")).agg(F.min(F.struct("edge_id", "source_label"))["source_label"].alias("label"))
    links = e.where("coalesce(target_id, '') <> ''").select("document_id", F.lower("source_id").alias("source"), F.lower("target_id").alias("target")).distinct()
    for end in ("source", "target"):
        links = links.join(n.select(F.col("k").alias(end), F.col("label").alias(f"{end}_label")), end)
    return links


@plans.add("""WITH n AS (SELECT id, max(label) AS label, max(type) AS type, min(edge_id) < '8' AS old FROM (SELECT source_id AS id, source_label AS label, source_type AS type, edge_id FROM graph_edges UNION ALL SELECT target_id, target_label, target_type, edge_id FROM graph_edges) WHERE id IS NOT NULL AND edge_id IS NOT NULL GROUP BY id)
SELECT id, CASE WHEN old THEN coalesce('new ' || label, label) ELSE 'new ' || label END AS label, type FROM n""")
def nodes_merged(spark: SparkSession, sf: str) -> DataFrame:
    """New nodes merged into old ones: given fields replace the old, missing ones stay."""
    e = table(spark, sf, "graph_edges").where("edge_id IS NOT NULL")
    ends = F.array(*[F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_label").alias("label"), F.col(f"{s}_type").alias("type")) for s in ("source", "target")])
    n = e.select("edge_id", F.explode(ends).alias("e")).where("e.id IS NOT NULL").groupBy("e.id").agg(F.max("e.label").alias("label"), F.max("e.type").alias("type"), (F.min("edge_id") < "8").alias("old")).withColumn("description", F.lit(""))
    new = n.withColumn("label", F.concat(F.lit("new "), "label")).withColumn("type", F.when(~F.col("old"), F.col("type")))
    return graph.merge_nodes(n.where("old").drop("old"), new.drop("old")).select("id", "label", "type")


@plans.add(f"SELECT DISTINCT event_id, CASE WHEN coalesce({norm('prompt')}, '') = '' THEN 0 ELSE 64 END AS dim, CASE WHEN coalesce({norm('prompt')}, '') = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS norm FROM response_feedback WHERE event_id IS NOT NULL")
def embedded_prompts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "response_feedback").where("event_id IS NOT NULL").select("event_id", "prompt").distinct()
    norm_of = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return models.embedded(p, "prompt").select("event_id", F.size("embedding").alias("dim"), norm_of.alias("norm"))


def _and_pairs(text: str) -> list[tuple[str, str, str]]:
    return [(a, "dan", b) for a, b in re.findall(r"([a-z]+) dan ([a-z]+)", text.lower())]


@plans.add("""WITH t AS (SELECT document_id, crawl_batch_id, lower(substr(content, 1, 9000)) AS t FROM corpus WHERE content IS NOT NULL), m AS (SELECT document_id, unnest(list_zip(regexp_extract_all(t, '([a-z]+) dan ([a-z]+)', 1), regexp_extract_all(t, '([a-z]+) dan ([a-z]+)', 2))) AS p FROM t)
SELECT DISTINCT document_id, p[1] AS source, 'dan' AS relation, p[2] AS target FROM m""")
def extracted_relations(spark: SparkSession, sf: str) -> DataFrame:
    """A rule in the place of a model: words joined by ``dan`` in the first 9,000 characters."""
    return models.extracted(table(spark, sf, "corpus"), "document_id", "content", _and_pairs).distinct()


@plans.add("SELECT DISTINCT event_id AS message_id, response AS text, 2::BIGINT AS n_texts, true AS done FROM response_feedback WHERE event_id IS NOT NULL AND response IS NOT NULL")
def answers_folded(spark: SparkSession, sf: str) -> DataFrame:
    """Answers sent as JSON lines, and put together again."""
    f = table(spark, sf, "response_feedback").where("event_id IS NOT NULL AND response IS NOT NULL").select("event_id", "response").distinct()
    half = F.floor(F.length("response") / 2).cast("int")

    def event(kind: str, text: Column | None = None) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), *([text.alias("text")] if text is not None else [])))

    parts = F.array(event("metadata"), event("text", F.substring(F.col("response"), F.lit(1), half)), F.lit("{broken"), event("text", F.substring(F.col("response"), half + 1, F.length("response"))), event("done"))
    return ingest.folded_answers(f.select(F.col("event_id").alias("message_id"), F.posexplode(parts).alias("seq", "value")))


@plans.add(store.plans.sql["staged_merge"])
def published_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A batch merged, published as a version of all three tables at once, merged again, and read from the newest version."""
    tables, staged = store.merge_state(spark, sf)
    held = Versions(spark, scratch(spark, "store"))
    for _ in range(2):
        for name, df in merging.staged_merge(tables, staged).items():
            held.put(name, df, replace=True)
        held.commit()
        tables = {name: held.table(name) for name in tables}
    return merging.union_all([df.select(F.lit(n).alias("name"), F.col(store.KEYS[n]).alias("key")) for n, df in tables.items()])


@plans.add("""WITH c AS (SELECT DISTINCT unnest(from_json(citations_json, '[{"title":"VARCHAR","url":"VARCHAR"}]')) AS c FROM response_feedback WHERE json_valid(citations_json) AND json_type(citations_json) = 'ARRAY') SELECT c.url AS url, min(c.title) AS title FROM c WHERE coalesce(c.url, '') <> '' GROUP BY c.url""")
def cited_once(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "response_feedback").select(F.explode(F.from_json("citations_json", "array<struct<title:string,url:string>>")).alias("c")).select("c.url", "c.title", F.lit(None).cast("string").alias("document_id"), F.lit(None).cast("int").alias("chunk_index"))
    return retrieval.cited_once(c, [F.asc_nulls_last("title")]).select("url", "title")


@plans.add("""SELECT DISTINCT source_url, CASE WHEN contains(source_url, '#') THEN lower(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || substr(cut, length(regexp_extract(cut, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) + 1) ELSE cut END AS loose FROM (SELECT source_url, regexp_replace(regexp_replace(source_url, '#.*$', ''), '/+$', '') AS cut FROM corpus WHERE source_url IS NOT NULL)""")
def bridge_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus").where("source_url IS NOT NULL").select("source_url").distinct().withColumn("loose", urls.bridge_url(F.col("source_url")))


# --- sources -------------------------------------------------------------------------------------

_SITE = "regexp_extract(lower(source_url), '^([a-z]+://[^/?#]+)', 1)"


@plans.add(f"SELECT DISTINCT trim(source_url) AS url FROM corpus WHERE source_url IS NOT NULL AND NOT contains(source_url, '&') AND {_SITE} <> ''")
def sitemap_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Every site's pages, listed in sitemaps that its root sitemap lists."""
    host = F.regexp_replace(F.regexp_extract(F.lower("source_url"), "^([a-z]+://[^/?#]+)", 1), r"^[a-z]+://(www\.)?", "")
    own = table(spark, sf, "corpus").where("source_url IS NOT NULL AND NOT contains(source_url, '&')").select("source_url", host.alias("host")).where("host <> ''").distinct()
    loc = lambda x: F.concat(F.lit("<url><LOC> "), x, F.lit(" </LOC></url>"))
    leaf = own.groupBy("host", F.concat(F.lit("https://"), "host", F.lit("/map-"), F.pmod(F.xxhash64("source_url"), F.lit(4)).cast("string"), F.lit(".xml")).alias("url")).agg(F.array_join(F.collect_list(loc(F.col("source_url"))), "\n").alias("body"))
    root = leaf.groupBy(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url")).agg(F.array_join(F.collect_list(loc(F.col("url"))), "").alias("body"))
    hosts = own.select("host").distinct().limit(10_001).collect()  # sites, as many as sources
    if len(hosts) > 10_000:
        raise ValueError("more than 10000 sites to start from")
    return crawl.expanded_sitemaps(root.unionByName(leaf.select("url", "body")), [f"https://{h.host}/sitemap.xml" for h in hosts])


@plans.add("SELECT DISTINCT source_url, title, source_url AS link FROM corpus WHERE source_url IS NOT NULL AND title IS NOT NULL AND NOT contains(source_url, '&') AND NOT contains(title, '<') AND trim(title) = title AND trim(source_url) = source_url AND title <> ''")
def feed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as entries of RSS and Atom feeds, read again."""
    c = table(spark, sf, "corpus").where("source_url IS NOT NULL AND title IS NOT NULL AND NOT contains(source_url, '&') AND NOT contains(title, '<') AND trim(title) = title AND trim(source_url) = source_url AND title <> ''").select("source_url", "title").distinct()
    rss = F.concat(F.lit("<rss><channel><title>t</title><link>x</link><item><title><![CDATA["), "title", F.lit("]]></title><link> "), "source_url", F.lit(" </link></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>"), "title", F.lit('</title><link rel="self" href="'), "source_url", F.lit('"/></entry></feed>'))
    xml = F.when(F.pmod(F.xxhash64("source_url"), F.lit(2)) == 0, rss).otherwise(atom)
    return c.select("source_url", F.explode(urls.feed_items(xml)).alias("i")).select("source_url", "i.title", "i.link")


@plans.add(f"""WITH {urls_cte('corpus', 'source_url')}, s AS (SELECT id, name, regexp_replace(trim(url), '/$', '') AS seed, include_patterns FROM crawl_sources),
h AS (SELECT DISTINCT s.id, s.seed, m.canonical AS url, include_patterns FROM corpus c JOIN url_map m ON c.source_url = m.u JOIN s ON s.name = c.source_name WHERE m.canonical <> '' AND {store.HOST.replace('{c}', 'm.canonical')} = {store.HOST.replace('{c}', 's.seed')} AND m.canonical <> s.seed)
SELECT id AS source_id, seed AS url, 0 AS depth FROM s UNION ALL SELECT id, url, 1 FROM h WHERE len(list_filter(include_patterns, lambda p: url LIKE replace(p, '*', '%'))) > 0""")
def discovered_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that the sources' addresses link to."""
    s = table(spark, sf, "crawl_sources")
    links = table(spark, sf, "corpus").where("source_url IS NOT NULL").select(F.col("source_name").alias("name"), F.col("source_url").alias("target")).distinct().join(bounded(s.select("name", F.col("url").alias("from_url"))), "name")
    return crawl.discovered(links.select("from_url", F.col("target").alias("url")), s, 2)


@plans.add("SELECT id, name FROM crawl_sources WHERE id IN (1, 3, 5, 7)")
def sources_selected(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.selected(table(spark, sf, "crawl_sources"), "1, 3, x, 5 7").select("id", "name")


@plans.add("SELECT DISTINCT document_id || '/' || coalesce(content_hash, 'none') || '.md' AS name FROM corpus WHERE content IS NOT NULL AND document_id IS NOT NULL")
def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "snapshots")
    files.write_snapshots(table(spark, sf, "corpus"), folder)
    return files.read_snapshots(spark, folder).select("name")


@plans.add("SELECT DISTINCT source_id, url FROM crawl_attempts WHERE source_id IS NOT NULL AND url IS NOT NULL")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "manifest")
    files.write_manifest(table(spark, sf, "crawl_attempts").where("source_id IS NOT NULL AND url IS NOT NULL"), folder)
    return spark.read.schema("source_id bigint, url string").json(folder)


@plans.add("SELECT DISTINCT edge_id FROM graph_edges WHERE edge_id IS NOT NULL AND source_id = 'zakat'")
def graph_reset(spark: SparkSession, sf: str) -> DataFrame:
    """A graph emptied and seeded again in one commit."""
    edges = table(spark, sf, "graph_edges").where("edge_id IS NOT NULL").select("edge_id", "source_id").distinct()
    held = Versions(spark, scratch(spark, "graph"))
    held.put("edges", edges)
    held.commit()
    held.reset(edges=edges.where("source_id = 'zakat'"))
    return held.table("edges").select("edge_id")


@plans.add("SELECT DISTINCT document_id, crawl_batch_id, CASE WHEN trim(coalesce(title, '')) <> '' THEN title WHEN trim(coalesce(category, '')) <> '' THEN category ELSE coalesce(source_name, '') END AS body FROM corpus WHERE document_id IS NOT NULL")
def first_bodies(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "corpus").where("document_id IS NOT NULL")
    return c.select("document_id", "crawl_batch_id", text.first_body(F.col("title"), F.col("category"), F.col("source_name")).alias("body")).distinct()
