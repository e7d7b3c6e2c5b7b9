import json

from pyspark.sql import functions as F

from loomspan.functions.partitions import spread
from loomspan.operators import crawl, graph, merging, retrieval
from loomspan.sources import files, schemas
from loomspan.streaming import ingest


def merge_state(spark):
    ts = "2024-01-0{}T00:00:00"
    c = lambda d, h, n: {"document_id": d, "content_hash": h, "created_at": ts.format(n), "updated_at": ts.format(n)}
    k = lambda i, d, h: {"chunk_id": i, "document_id": d, "content_hash": h, "created_at": ts.format(1)}

    def make(name, rows):
        df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
        return df.select(F.from_json("j", schemas.schema(name)).alias("r")).select("r.*")

    target = {"corpus": make("corpus", [c("d1", "h1", 1), c("d2", "h2", 1)]), "chunks": make("chunks", [k("c1", "d1", "h1"), k("c2", "d1", "h1"), k("c3", "d2", "h2"), k("c4", "d2", None), k("c6", "d1", "h9")]), "graph_edges": make("graph_edges", [])}
    staged = {"corpus": make("corpus", [c("d1", "h9", 2), c("d1", "h10", 3), c("d3", "h3", 2)]), "chunks": make("chunks", [k("n1", "d1", "h10"), k("c5", "d3", "h3")]), "graph_edges": make("graph_edges", [])}
    return target, staged


def test_staged_merge_and_again(spark):
    target, staged = merge_state(spark)
    out = merging.staged_merge(target, staged)
    docs = {r.document_id: (r.content_hash, r.created_at.day) for r in out["corpus"].collect()}
    assert docs == {"d1": ("h10", 1), "d2": ("h2", 1), "d3": ("h3", 2)}
    assert sorted(r.chunk_id for r in out["chunks"].collect()) == ["c3", "c4", "c5", "n1"]
    again = merging.staged_merge(out, staged)
    for name in out:
        assert sorted(map(str, again[name].collect())) == sorted(map(str, out[name].collect()))


def test_conform_adds_and_drops(spark):
    df = schemas.conform(spark.createDataFrame([("a", 1)], "document_id string, other int"), "corpus")
    assert df.columns == schemas.schema("corpus").names and df.first()["title"] is None


def test_cosine(spark):
    def cos(a, b):
        df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        return df.select(retrieval.cosine(F.col("a"), F.col("b")).alias("c")).first()["c"]

    assert round(cos([1.0, 2.0], [3.0, 4.0]), 6) == 0.983870
    assert cos([0.0, 0.0], [1.0, 2.0]) is None
    assert round(cos([1.0, 2.0, 9.0], [3.0, 4.0]), 6) == 0.983870


def test_top_vectors_ties_and_empty(spark):
    items = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", []), ("d", None)], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [(r.chunk_id, r.rank) for r in retrieval.top_vectors(items, q, 5).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert retrieval.top_vectors(items.limit(0), q, 5).count() == 0


def test_citations_once(spark):
    c = spark.createDataFrame([("u", "d", 0, 1), ("u", "d", 0, 2), ("", "d", 1, 3)], "url string, document_id string, chunk_index int, pos int")
    assert [r.pos for r in retrieval.cited_once(c, [F.col("pos")]).collect()] == [1]


def test_graph(spark):
    nodes = spark.createDataFrame([("N1", "A", "Konsep", "", 0), ("n1", "B", "Konsep", "x", 1)], "id string, label string, type string, description string, pos int")
    links = spark.createDataFrame([("n1", "zz", "R")], "source string, target string, relation string")
    r = graph.edge_rows(links, nodes).first()
    assert (r.source_label, r.target_label, r.target_type, r.target_description) == ("B", "zz", "Entity", "")
    l = spark.createDataFrame([("a", "b", "R"), ("b", "b", "S")], "source string, target string, relation string")  # noqa: E741
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    d = {r.id: r.degree for r in graph.degrees(l, n).collect()}
    assert d == {"a": 1, "b": 3, "c": 0} and sum(d.values()) == 2 * l.count()
    assert {r.id for r in graph.neighbourhood(l, "a").collect()} == {"a", "b"}
    new = spark.createDataFrame([("A", "B", "r"), ("a", "c", "R")], "source string, target string, relation string")
    assert graph.merge_links(l, new).count() == 3
    reached = graph.reached(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string"), spark.createDataFrame([("a",)], "id string"), 2)
    assert {(r.id, r.depth) for r in reached.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    old = spark.createDataFrame([("A", "x", "t", None)], "id string, label string, type string, description string")
    fresh = spark.createDataFrame([("a", None, "u", "d")], "id string, label string, type string, description string")
    assert [tuple(r) for r in graph.merge_nodes(old, fresh).collect()] == [("A", "x", "u", "d")]


def test_status_roll_up(spark):
    cases = [(["SUCCESS", "SKIPPED_NOT_CONFIGURED"], "SUCCESS"), (["SUCCESS", "FAILED"], "PARTIAL"), (["PARTIAL"], "FAILED"), ([], "SKIPPED_NOT_CONFIGURED")]
    for s, want in cases:
        df = spark.createDataFrame([(s,)], "s array<string>")
        assert df.select(crawl.rolled_up(F.col("s")).alias("x")).first()["x"] == want


def test_jsonl(spark, tmp_path):
    (tmp_path / "chunks-0.jsonl").write_text('{"chunk_id": "a", "chunk_index": 1, "unknown": 3}\n{broken\n')
    (tmp_path / "other.jsonl").write_text('{"chunk_id": "b"}\n')
    assert [r.chunk_id for r in files.read_shards(spark, "chunks", str(tmp_path)).where("chunk_id IS NOT NULL").collect()] == ["a"]
    assert files.read_jsonl(spark, "chunks", []).count() == 0
    (tmp_path / "f.jsonl").write_text('\n  \n{"event_id": "e", "rating": "up"}\nnot json\n')
    assert [r.event_id for r in files.read_feedback(spark, str(tmp_path / "f.jsonl")).collect()] == ["e"]
    df = spark.range(11).select(F.format_string("%03d", "id").alias("k")).repartition(3)
    got = files.shard_numbers(df, ["k"], 4).groupBy("shard").agg(F.min("k").alias("m"), F.count("*").alias("n")).orderBy("shard").collect()
    assert [(r.shard, r.m, r.n) for r in got] == [(0, "000", 4), (1, "004", 4), (2, "008", 3)]


def test_lru_replay(spark):
    log = spark.createDataFrame([("s", 0.0, "a"), ("s", 1.0, "b"), ("s", 2.0, "a"), ("s", 3.0, "c"), ("s", 4.0, "b"), ("s", 200.0, "b")], "scope string, at double, key string")
    r = ingest.lru_replay(log, 2, 100).first()
    # a, b missed; a hit; c missed and b goes; b missed and a goes; b expired: eviction and miss
    assert (r.hits, r.misses, r.sets, r.evictions, r["size"]) == (1, 5, 5, 3, 2)


def test_stream_is_replayable(spark, tmp_path):
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    schema = "k string, v int, t int"
    for n, rows in enumerate(([("a", 1, 1), ("b", 1, 1)], [("a", 2, 2), ("a", 3, 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        sink = ingest.keep_latest(out, ["k"], ["t", "v"], most_parts=1)
        q = ingest.start(ingest.read_folder(spark, src, schema), sink, str(tmp_path / "c"))
        q.awaitTermination()
        got = {(r.k, r.v) for r in ingest.latest(spark, out, ["k"], ["t", "v"]).collect()}
    assert n == 1 and got == {("a", 2), ("b", 1)}
    sink(spark.createDataFrame([("a", 9, 9)], schema), 1)  # the batch is run again: nothing changes
    assert {(r.k, r.v) for r in ingest.latest(spark, out, ["k"], ["t", "v"]).collect()} == got
    sink(spark.createDataFrame([("a", 4, 3)], schema), 2)
    assert {(r.k, r.v) for r in ingest.latest(spark, out, ["k"], ["t", "v"]).collect()} == {("a", 4), ("b", 1)}


def test_late_events_are_dropped_in_streams(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "view", 1.0), ("2024-01-01 00:20:00", "view", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    r = ingest.windowed_counts(df).first()
    assert (r.n, r.total) == (2, 3.0)


def test_spread_leaves_plans_with_shuffles(spark):
    df = spark.range(10).groupBy("id").count()
    assert spread(df) is df


def test_empty_tables(spark):
    runs = spark.createDataFrame([], schemas.schema("crawl_runs"))
    attempts = spark.createDataFrame([], schemas.schema("crawl_attempts"))
    edges = spark.createDataFrame([], schemas.schema("graph_edges"))
    assert crawl.latest_runs(runs).count() == crawl.progress(runs).count() == crawl.completeness(attempts).count() == 0
    assert graph.graph_nodes(edges, "edge_id").count() == graph.graph_links(edges).count() == 0


def test_sitemaps(spark):
    xml = lambda *u: "<urlset>" + "".join(f"<loc>{x}</loc>" for x in u) + "</urlset>"
    pages = spark.createDataFrame([("https://a.example/s.xml", xml("https://a.example/1", "https://a.example/t.xml", "https://b.example/9")), ("https://a.example/t.xml", xml("https://a.example/2", "https://a.example/s.xml"))], "url string, body string")
    assert sorted(r.url for r in crawl.expanded_sitemaps(pages, "https://a.example/s.xml").collect()) == ["https://a.example/1", "https://a.example/2"]


def test_views_and_payloads(spark, sf, tmp_path):
    from loomspan.sources import views

    assert "corpus" in views.register(spark, sf)
    assert spark.sql("SELECT count(*) AS n FROM corpus WHERE source_name = :s", args={"s": "none"}).first()["n"] == 0
    (tmp_path / "p.json").write_text(json.dumps({"ok": True, "documents": [{"url": "u", "title": "t", "content": "c", "depth": "x", "status_code": 200}], "errors": [{"url": "v", "error": "e"}]}))
    spark.dataSource.register(views.CrawlPayloads)
    got = spark.read.format("crawl_payloads").option("paths", str(tmp_path / "p.json")).load().collect()
    assert sorted((r.url, r.depth, r.error) for r in got) == [("u", 0, None), ("v", 0, "e")]


def test_vectors_of_unequal_length_and_many_blocks(spark, monkeypatch):
    import numpy as np

    draw = np.random.default_rng(1)
    data = [(f"i{k:02d}", draw.normal(size=3 if k % 4 else 2).tolist()) for k in range(40)]
    items = spark.createDataFrame(data, "chunk_id string, embedding array<double>")
    asked = [(k, draw.normal(size=3).tolist()) for k in range(7)]
    q = spark.createDataFrame(asked, "query_id bigint, embedding array<double>")
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 48)  # two questions a block

    def cosine(x, y):
        n = min(len(x), len(y))
        x, y = np.array(x[:n]), np.array(y[:n])
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y)

    want = {(k, i) for k, v in asked for i, _ in sorted(data, key=lambda d: (-cosine(d[1], v), d[0]))[:5]}
    assert {(r.query_id, r.chunk_id) for r in retrieval.top_vectors(items, q, 5).collect()} == want


def test_holding_words(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "zakat fitrah", None), (2, "wakaf", "harta"), (3, None, None)], "id int, a string, b string")
    words = spark.createDataFrame([("zak",), ("ta",), ("kat f",), ("",), (None,), ("ta",)], "word string")
    monkeypatch.setattr(retrieval, "AUTOMATON_WORDS", 2)
    got = sorted((r.id, r.word) for r in retrieval.holding_words(rows, ["a", "b"], words).collect())
    assert got == [(1, "kat f"), (1, "zak"), (2, "ta")]
    assert retrieval.holding_words(rows, ["a"], words.limit(0)).count() == 0


def test_appends_can_be_repeated_with_null_keys(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), (None, "b"), ("a", "b")], "x string, y string")
    once = merging.new_rows(rows, rows.limit(0), ["x", "y"])
    assert once.count() == 3 and merging.new_rows(rows, once, ["x", "y"]).count() == 0


def test_batch_totals_of_nulls(spark):
    rows = spark.createDataFrame([("b", "d2", "T2", "z", "xx"), ("b", "d1", None, "y", None), ("b", "d3", "T3", "y", "x"), ("b", "d3", "T3", "y", "x"), (None, "d", "t", "c", "c")], "crawl_batch_id string, document_id string, title string, crawler string, content string")
    r = crawl.batch_totals(rows).collect()
    assert [(x.n_documents, x.characters, x.first_title, x.crawlers) for x in r] == [(3, 3, "T2", "y+z")]


def test_two_nodes_stand_left_and_right(spark):
    n = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "g string, id string")
    assert sorted((r.id, r.x, r.y) for r in graph.ellipse_layout(n, "g", "id").collect()) == [("a", -110.0, 0.0), ("b", 110.0, 0.0), ("c", 0.0, 0.0)]


def test_too_many_rows_to_take_along(spark):
    import pytest

    from loomspan.functions.partitions import bounded

    assert bounded(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        bounded(spark.range(4), 3)
