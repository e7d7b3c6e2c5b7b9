"""Feedback, sessions, crawl states and model calls: the cases of their docstrings."""

from pyspark.sql import functions as F

from loomspan.functions import models
from loomspan.operators import crawl, feedback, sessions
from loomspan.streaming import ingest


def test_feedback_record_by_record(spark):
    rows = [("e1", "s", "m", "up", "q", "a", "", 1), ("e2", "s", "m", None, "", "b", "salah", 2), ("e3", "s", "m", "odd", None, None, " ", 3), ("e3", "s", "m", "odd", None, None, " ", 3), ("e4", None, "m", None, None, None, None, 1)]
    e = spark.createDataFrame(rows, "event_id string, session string, message string, rating string, question string, answer string, comment string, created_at int").withColumn("citations", F.lit(None).cast("array<struct<title:string,url:string>>"))
    got = {r.session: r for r in feedback.folded(e, ["session", "message"]).collect()}
    r = got["s"]
    assert (r.rating, r.question, r.answer, r.comment, r.pipeline_status, r.created_at, r.updated_at, r.n_events) == ("down", "q", "b", " ", "none", 1, 3, 3)
    assert got[None].rating == "down" and got[None].question == "" and got[None].citations == []
    assert feedback.folded(e.limit(0), ["session"]).count() == 0


def test_patches_change_what_is_valid(spark):
    rec = spark.createDataFrame([("1", "new", "none", "", ""), ("2", "new", "queued", "x", "p")], "id string, review_status string, pipeline_status string, reviewer_note string, improvement_plan string")
    patch = spark.createDataFrame([("2", "bogus", "applied", "", "plan"), ("9", "new", "none", "", "")], rec.schema)
    got = {r.id: tuple(r)[1:] for r in feedback.patched(rec, patch, "id").collect()}
    assert got == {"1": ("new", "none", "", ""), "2": ("new", "applied", "x", "plan")}
    assert {r.review_status for r in feedback.drafted(rec, F.lit("p")).collect()} == {"reviewing"}
    assert feedback.counts(rec.withColumn("rating", F.lit("up")).limit(0)).first().down_rate == 0


def test_messages_and_graphs(spark):
    m = [(str(k), "robot" if k % 2 else "user", None if k == 90 else "c" * 13_000, "bad" if k == 95 else "2024-01-02 03:04:05") for k in range(100)]
    df = spark.createDataFrame([(m,), (None,), ([],)], "m array<struct<id:string,role:string,content:string,timestamp:string>>")
    got = [r.x for r in df.select(sessions.messages(F.col("m"), F.lit("2000-01-01").cast("timestamp")).alias("x")).collect()]
    assert got[1] is None and got[2] == []
    assert [x.id for x in got[0]] == [str(k) for k in range(20, 100) if k != 90]
    assert {x.role for x in got[0]} == {"user", "model"} and all(len(x.content) == 12_000 for x in got[0])
    assert sum(x.timestamp.year == 2000 for x in got[0]) == 1
    nodes = [(f"n{k:03d}", None, "", "d") for k in range(100)] + [(None, "t", "l", "d")]
    links = [("n000", "n001", None), ("n000", "n090", "R"), ("n079", "n000", "R")]
    g = spark.createDataFrame([(nodes, links)], "n array<struct<id:string,type:string,label:string,description:string>>, l array<struct<source:string,target:string,relation:string>>")
    x = g.select(sessions.graph_parts(F.col("n"), F.col("l")).alias("g")).first().g
    assert len(x.nodes) == 80 and x.nodes[0] == ("n000", "Entity", "n000", "d")
    assert [tuple(e) for e in x.links] == [("n000", "n001", "RELATION"), ("n079", "n000", "R")]


def test_keys_ids_and_tiers(spark):
    df = spark.createDataFrame([("Apa itu zakat?", "a" * 20), ("x" * 1001, "short"), (None, None)], "m string, c string")
    none = F.lit(None).cast("array<struct<role:string,content:string>>")
    got = df.select(sessions.answer_key(F.col("m"), none, F.lit(1), F.lit("m")).alias("a"), sessions.answer_key(F.col("m"), none, F.lit(2), F.lit("m")).alias("b"), sessions.session_id(F.col("c"), F.lit("new")).alias("s")).collect()
    assert got[0].a != got[0].b and got[1].a is None and got[2].a is not None
    assert [r.s for r in got] == ["a" * 20, "new", "new"]
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    tier = lambda rows: spark.createDataFrame(rows, "key string, value string, version int")
    out = sessions.two_tiers(asked, tier([("a", "1", 1), ("b", "old", 0)]), tier([("a", "2", 1), ("b", "3", 1)]), "key", "value", 1)
    assert sorted(tuple(r) for r in out.collect()) == [("a", "1", "local"), ("b", "3", "shared"), ("c", None, "compute")]


def test_crawl_states(spark):
    d = spark.createDataFrame([("b", "d1", "http://A.example/x/", 1), ("b", "d2", "http://a.example/x#y", 2), ("b", "d3", "", 3), ("b", "d4", None, 4), ("b", "d5", "http://a.example/z", 5)], "crawl_batch_id string, document_id string, source_url string, pos int")
    assert [(r.document_id, r.place) for r in crawl.unique_documents(d, "crawl_batch_id", "pos", 2).orderBy("place").collect()] == [("d1", 1), ("d5", 2)]
    s = spark.createDataFrame([("SUCCESS",), ("skipped_x",), ("gcs_not_configured",), (None,), ("",)], "s string")
    assert [r.x for r in s.select(crawl.stored(F.col("s")).alias("x")).collect()] == [True, False, False, False, False]
    assert [r.x for r in s.select(crawl.log_status(F.col("s")).alias("x")).collect()] == ["SUCCESS"] * 5
    caps = spark.createDataFrame([(None, None), (0, 0), (9, -4), (2, 50)], "d int, o int").select(crawl.page_cap(F.col("d")).alias("a"), crawl.page_cap(F.col("d"), F.col("o")).alias("b")).collect()
    assert [(r.a, r.b) for r in caps] == [(3, 3), (3, 3), (3, 1), (2, 50)]
    a = spark.createDataFrame([("r", "u", "DISCOVERED", 1, "d"), ("r", "u", "FAILED", 2, "d"), ("r", "u", "PREPARED", 2, "d"), (None, "u", "FAILED", 3, "d")], "run_id string, normalized_url string, status string, updated_at int, document_id string")
    assert [tuple(r) for r in crawl.attempt_states(a).collect()] == [("r", "u", "FAILED", "d", 3)]


def test_model_calls(spark):
    df = spark.createDataFrame([(1, "Zakat Fitrah"), (2, "zakat  fitrah!"), (3, None), (4, "?")], "id int, t string")
    got = {r.id: r.embedding for r in models.embedded(df, "t").collect()}
    assert got[1] == got[2] and len(got[1]) == 64 and got[3] == got[4] == []

    def fails(texts):
        raise RuntimeError

    assert {tuple(r.embedding) for r in models.embedded(df, "t", fails).collect()} == {()}
    rule = lambda t: [("a", "r", t[:1]), ("a", "r", t[:1])] if t[0] != "?" else 1 / 0
    assert sorted(tuple(r) for r in models.extracted(df, "id", "t", rule).collect()) == [(1, "a", "r", "Z"), (2, "a", "r", "z")]


def test_answers_from_lines(spark):
    lines = [("m", 3, '{"type":"text","text":"b"}'), ("m", 1, '{"type":"text","text":"a"}'), ("m", 2, "broken"), ("m", 4, '{"type":"other"}'), ("n", 1, '{"type":"metadata"}'), ("n", 2, '{"type":"done"}')]
    got = {r.message_id: (r.text, r.n_texts, r.done) for r in ingest.folded_answers(spark.createDataFrame(lines, "message_id string, seq int, value string")).collect()}
    assert got == {"m": ("ab", 2, False), "n": ("", 0, True)}


def test_discovery_stays_on_the_host(spark):
    s = spark.createDataFrame([(1, "https://a.example/", ["https://a.example/n/*"])], "id bigint, url string, include_patterns array<string>")
    links = [("https://a.example", "https://a.example/n/1"), ("https://a.example", "https://b.example/n/1"), ("https://a.example/n/1", "https://a.example/n/2/"), ("https://a.example/n/2", "https://a.example/n/3"), ("https://a.example", "https://a.example/m"), ("https://a.example/m", "https://a.example/n/4")]
    df = spark.createDataFrame(links, "from_url string, url string")
    got = {(r.url, r.depth) for r in crawl.discovered(df, s, 2).collect()}
    assert got >= {("https://a.example/n/1", 1), ("https://a.example/n/2", 2), ("https://a.example/n/4", 2)} and len(got) == 4
    assert {r.url for r in crawl.discovered(df, s, 2, most=1).collect()} >= {"https://a.example/n/1"}
    assert [r.id for r in crawl.selected(s, "all").collect()] == [1] and crawl.selected(s, "2").count() == 0
