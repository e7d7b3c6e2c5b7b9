from pyspark.sql import functions as F

from loomspan.functions import ids, partitions, text, urls
from loomspan.functions.partitions import once, spread


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, text.normalize_text(F.col("s")), s="Syafi'i’s Café — Zakât!") == "syafiis cafe zakat"
    assert one(spark, text.normalize_text(F.col("s")), s="straße") == "stra e"
    assert one(spark, text.normalize_text(F.col("s")), s="الفقه") == ""
    assert one(spark, text.normalize_text_exact(F.col("s")), s="Syafi'i’s Café — Zakât!") == "syafiis cafe zakat"
    assert one(spark, text.slugify(F.col("s")), s="Mufti WP - Al-Kafi li al-Fatawi") == "mufti-wp-al-kafi-li-al-fatawi"
    assert one(spark, text.slugify(F.col("s")), s="***") == "item"


def test_lemmas(spark):
    want = {"feqah": "fiqh", "sembahyang": "solat", "syariat": "syariah", "hukumnya": "hukum", "bersolat": "solat", "pembelajaran": "belajar", "pendapatan": "dapat", "makan": "makan", "keluarga": "luarga", "mengenai": "gena", "berdasarkan": "dasar", "kepemimpinan": "pemimpin", "suci": "suci"}
    rows = spark.createDataFrame([(w,) for w in want], "w string").select("w", text.lemma(F.col("w")).alias("l")).collect()
    assert {r.w: r.l for r in rows} == want
    assert {w: text._lemma_of(w) for w in want} == want
    assert one(spark, text.keywords(F.col("s")), s="mengenai zakat") == ["gena", "zakat"]
    assert one(spark, text.keywords(F.col("s")), s="bagaimanakah hukum") == []


def test_relevance(spark):
    def kept(hay, words):
        w = F.array(*[F.lit(x) for x in words]).cast("array<string>")
        return one(spark, text.is_relevant(text.matched_keywords(text.searchable(F.col("h")), w), w), h=hay)

    assert kept("apa sahaja", [])
    assert kept("tentang pinjaman sahaja", ["pinjaman"]) is True
    assert kept("tentang zakat sahaja", ["zakat"]) is False
    assert kept("zakat dan riba", ["zakat", "riba"]) is True


def test_urls(spark):
    want = {"HTTPS://WWW.Example.com/A/?b=2&a=1#x": "https://www.example.com/A/?a=1&b=2", "https://example.com": "https://example.com/", "https://example.com/a/": "https://example.com/a", "https://example.com:443/a": "https://example.com/a", "not a url/#f": "not a url", "": ""}
    rows = spark.createDataFrame([(u,) for u in want], "u string").select("u", urls.normalize_url(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in rows} == want
    assert one(spark, urls.bridge_url(F.col("u")), u="HTTPS://WWW.Example.com/A/?b=2&a=1#x") == "https://WWW.Example.com/A/?b=2&a=1"
    assert one(spark, urls.matches_any(F.lit("https://example.com/abc"), F.array(F.lit("*example.com/a*")))) is True
    assert one(spark, urls.matches_any(F.lit("https://EXAMPLE.com/abc"), F.array(F.lit("*example.com/a*")))) is False
    assert one(spark, urls.absolutize(F.lit("https://a.example/x/y"), F.lit("z?b=1&amp;a=2"))) == "https://a.example/x/z?a=2&b=1"
    assert one(spark, urls.sitemap_locs(F.lit("<urlset><loc> https://a.example/1 </loc></urlset>"))) == ["https://a.example/1"]


def test_ids(spark):
    assert one(spark, ids.document_id(F.lit("https://example.com/a"))) == "web-2dce0a4c50441bfccfa9caf4"
    assert one(spark, ids.content_hash(F.lit("https://example.com/a"), F.lit("T"), F.lit("line1\r\nline2"))) == "f1f2e0ce2dc477bcd7cf4a93c0f9daf53b26078b52f6c997c6befe523f22241c"
    assert one(spark, ids.chunk_id(F.lit("web-2dce0a4c50441bfccfa9caf4"), F.lit(0), F.lit("hello world paragraph one"))) == "ebfb3d33f144a9c39285eafe"
    assert one(spark, ids.edge_id(F.lit("doc1"), F.lit("feqah"), F.lit("CABANG_KEPADA"), F.lit("syariah"))) == "46322f8f6aa3441e7fabfe1f"


def test_chunker(spark):
    lines = "aaaa\nbbbb\ncc\ndddddddddddddddd\neeee"
    assert one(spark, text.chunks(F.col("s"), 12, 3), s=lines) == ["aaaa\nbbbb", "dddddddddddddddd", "eeee"]
    assert one(spark, text.chunks(F.col("s")), s="") == []


def test_small_text_functions(spark):
    assert [one(spark, text.truncate(F.lit("abcdef"), n)) for n in (5, 3, 9)] == ["ab...", "abc", "abcdef"]
    assert one(spark, text.compact_markdown(F.lit("a\r\n\n\n\nb  c ![x](y)"))) == "a\n\nb c"
    for n, word, ok in ((449, "", False), (450, "", True), (899, "cookie", False), (900, "cookie", True)):
        assert one(spark, text.is_article(F.lit((word + "x" * n)[:n]))) is ok
    assert one(spark, text.rulings(F.lit("hukumnya Haram, bukan wajib"))) == ["HARAM", "WAJIB"]
    assert one(spark, text.yaml_string(F.lit('a "b" \\c'))) == '"a \\"b\\" \\\\c"'
    assert one(spark, text.title_of(F.lit("# short\n## A longer heading\n"), F.lit(None).cast("string"))) == "A longer heading"
    assert one(spark, text.html_text(F.lit("<script>x<1</script><p>a <b>b</b></p><!-- c -->"))) == "a b"


def test_once_is_distinct(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 1), (None, "a", 1), ("b", "c", 2), ("b", "c", 2), ("b", "c", 3)], "x string, y string, z int")
    assert sorted(once(df).collect(), key=str) == sorted(df.distinct().collect(), key=str)
    assert once(df.limit(0)).count() == 0


def test_spread_leaves_large_and_wide_plans_alone(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert spread(df.where("id > 3").select("id")).rdd.getNumPartitions() > 1
    grouped = df.groupBy("id").count()
    assert spread(grouped) is grouped
    monkeypatch.setattr(partitions, "SPREAD_BYTES", 10)
    assert spread(df) is df


def test_relative_links(spark):
    f = lambda base, href: one(spark, urls.absolutize(F.col("b"), F.col("h")), b=base, h=href)
    assert f("https://a.example/x/y/z", "../w") == "https://a.example/x/w"
    assert f("https://a.example/x/y/z", "./w/./v") == "https://a.example/x/y/w/v"
    assert f("https://a.example/x", "../../w") == "https://a.example/w"
    assert f("https://a.example/x?a=1", "?b=2&a=1") == "https://a.example/x?a=1&b=2"
    assert f("https://a.example/x/", "/a/../b/..") == "https://a.example/"
    assert f("nothing", "w") == ""


def test_feeds(spark):
    xml = "<rss><channel><link>no</link><item><title>A &amp; B</title><link>https://a.example/?x=1&amp;y=2</link></item><item><title>C</title></item></channel></rss>"
    assert [tuple(x) for x in one(spark, urls.feed_items(F.col("s")), s=xml)] == [("https://a.example/?x=1&y=2", "A &amp; B"), ("", "C")]
    assert one(spark, urls.feed_items(F.col("s")), s="") == []


def test_words_of_a_list_match_alike_on_both_paths(spark):
    words = ["solat", "hukum puasa", "", "diperkenalkan", "syafi'i"]
    df = spark.createDataFrame([("Sembahyang dan hukum berpuasa",), ("Mazhab Syafi'i diperkenalkannya",), ("",), (None,)], "s string")
    normal = text.normalize_text(F.col("s"))
    rows = df.select(text.matched_arrow(normal, words).alias("a"), text.matched_keywords(text.searchable(F.col("s")), F.array(*map(F.lit, words))).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[0].a == ["solat", "hukum puasa"]
