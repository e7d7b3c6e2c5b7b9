"""Each problem's operator against brute force, exact round trips and the cases of its docstring."""

import glob
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import batches, leakage, mixing, neighbours, pages, registry, repeated_lines, residue, sentences, splitting
from loomspan.llm.words import WordIds, words

TOKENIZERS = os.path.exists(mixing.TOKENIZER)


def folder(path, name="state"):
    return f"file://{path}/{name}"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- words ---------------------------------------------------------------------------------------


def test_words():
    assert words("Café, ZAKÂT-2! naïve") == ["cafe", "zakat", "2", "naive"]
    assert words(None) == words("") == words(" \n.") == []
    assert words("كِتَاب") == ["كتاب"]
    assert WordIds().of("a b a")[0] == WordIds().of("A")[0]


# --- 1 -------------------------------------------------------------------------------------------

PAGE = """Home | About | Gallery
* [Menu](https://a.example/menu)

We use cookies to remember you. By continuing you agree.
Home › website > Hukum jual beli
# Hukum jual beli
Oleh: Encik A
👁 12 paparan

Perkara pertama yang perlu difahami ialah bahawa jual beli itu harus pada asalnya menurut kebanyakan ulama.
- Iklan -
- Satu perkara pendek
1. Dua
Baca juga: Hukum sewa
Perkara kedua ialah syarat sah jual beli yang mesti dipenuhi oleh kedua-dua pihak sebelum akad itu sah.
Rujukan: Kitab X, jil. 2, hlm. 3; [nota](https://r.example/1)
Tag: jual, beli
Paling Popular
Hukum pinjaman peribadi
© 2024 Portal. Hak cipta terpelihara."""


def test_page_body():
    lines = PAGE.split("\n")
    kept = [x for x, ok in zip(lines, pages.article_lines(PAGE, "Hukum jual beli"), strict=True) if ok]
    assert kept[0] == "# Hukum jual beli" and kept[-1].startswith("Rujukan")
    assert "- Satu perkara pendek" in kept and "1. Dua" in kept
    assert not any(x.startswith(("Oleh", "Baca", "- Iklan", "👁", "Tag", "Paling", "©", "We use", "Home", "*")) for x in kept)
    assert not pages.article_lines("", None).any() and not pages.article_lines("\n\n..", "x").any()
    assert pages.is_furniture("Meja Pengarang, Aras 2, Kompleks X, Jalan Y") and not pages.is_furniture("Hukum menutup jalan")


def test_page_tables(spark):
    df = spark.createDataFrame([("a", "b1", "Hukum jual beli", PAGE, 1), ("n", "b1", None, None, 2), ("e", "b1", "t", "", 3)], "document_id string, crawl_batch_id string, title string, content string, line_no int")
    got = pages.furniture_lines(df)
    assert got.columns == ["document_id", "crawl_batch_id", "line_no"] and {r.document_id for r in got.collect()} == {"a"}
    assert {r.document_id: r.body for r in pages.bodies(df, ("document_id",), "content", "title").collect()}["n"] is None
    assert pages.furniture_lines(df.limit(0)).count() == 0


UNLISTED = [
    ("Start | Rooms | Prices | Imprint", "Choose your language: DE", "Opening hours: 9:00"),
    ("[Kulit Depan](https://x.example/) [Sejarah](https://x.example/s)", "Bilangan capaian 31337", "@ 12/3/2024 10:15"),
    ("☎ Talian aduan", "Edisi: Rabu", "Disalin daripada: Harian Baru"),
]
ENDS = [
    ("Rangkaian: Satu Dua Tiga", "Sign up for our weekly digest of stories.", "All trademarks are the property of their owners."),
    ("#hukum #wakaf", "[Kisah lain](https://x.example/1)", "By using this site you accept the terms of use that apply."),
    ("♥ 12", "Alamat: Lot 7", "Semua tanda dagang ialah milik pemilik masing-masing."),
]


@pytest.mark.parametrize("above", UNLISTED)
@pytest.mark.parametrize("below", ENDS)
def test_furniture_that_no_list_knows(above, below):
    body = [
        "# Hukum wakaf tunai", "Perkara pertama yang perlu difahami ialah bahawa wakaf tunai itu harus menurut kebanyakan ulama di rantau ini, dan tujuannya besar.",
        "Berita terkini mengenai wakaf di negara kita", "Perkara kedua ialah syarat sah wakaf yang mesti dipenuhi oleh pewakaf sebelum akad itu dianggap sempurna oleh pihak penerima amanah.",
        "1. Harta itu milik penuh pewakaf.", "2. Harta itu kekal manfaatnya.", "Perkara ketiga ialah penerima wakaf, iaitu pihak yang menguruskan harta tersebut dan melaporkan hasilnya kepada orang ramai setiap tahun.",
    ]
    page = "\n".join([*above, *body, *below])
    kept = [x for x, ok in zip(page.split("\n"), pages.article_lines(page, "Hukum wakaf tunai", lambda _: False), strict=True) if ok]
    assert kept == body


def test_windows_decide(monkeypatch):
    long = "Ayat ini panjang dan menceritakan perkara yang penting tentang hukum jual beli kepada pembaca."
    page = "\n".join(["Tajuk", *[long] * 6, *["pautan kecil"] * 8, "Satu ayat penutup yang agak panjang tetapi berdiri sendiri sahaja di bawah.", *["pautan lain"] * 4])
    kept = pages.article_lines(page, "Tajuk")
    assert kept[:7].all() and not kept[7:].any()  # the late line's window is below the page's level
    monkeypatch.setattr(pages, "LEVEL_SHARE", 0.0)
    monkeypatch.setattr(pages, "LEAST_SURGE", 0)
    assert pages.article_lines(page, "Tajuk")[15]
    assert pages.text_block(np.zeros(4, int), np.ones(4, bool)) is None


def test_lines_far_from_the_article_are_not_judged():
    asked = []
    page = "\n".join([*(f"pautan {chr(97 + k)}" for k in range(20)), PAGE, *(f"kisah {chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400))])
    kept = pages.article_lines(page, "Hukum jual beli", lambda x: asked.append(x) or pages.is_furniture(x))
    assert len(asked) < 40 and [x for x, ok in zip(page.split("\n"), kept, strict=True) if ok] == [x for x, ok in zip(PAGE.split("\n"), pages.article_lines(PAGE, "Hukum jual beli"), strict=True) if ok]


# --- 2 -------------------------------------------------------------------------------------------


def vectors(spark, x, start=0):
    return spark.createDataFrame([(f"k{i + start:06d}", None if v is None else [float(y) for y in v]) for i, v in enumerate(x)], "chunk_id string, embedding array<double>").withColumn("created_at", F.current_timestamp()).withColumn("vec", F.lit(1))


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return [set(np.argsort(-r)[:k]) for r in s]


def test_recall(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(60, 96))
    x = centres[draw.integers(0, 60, 3000)] + 0.5 * draw.normal(size=(3000, 96))
    got = defaultdict(set)
    for r in neighbours.nearest(vectors(spark, x)).collect():
        got[int(r.chunk_id[1:])].add(int(r.near_chunk_id[1:]))
    want = brute(x, 5)
    assert all(len(v) == 5 for v in got.values()) and len(got) == 3000
    assert np.mean([len(got[i] & w) / 5 for i, w in enumerate(want)]) >= 0.9


def test_equal_vectors_and_unusable_ones(spark):
    one = np.arange(1.0, 97)
    draw = np.random.default_rng(1)
    x = [one * 2] * 40 + [None, [], [1.0] * 48, [0.0] * 96, [float("nan")] * 96] + list(draw.normal(size=(30, 96)))
    df = vectors(spark, x)
    got = defaultdict(dict)
    for r in neighbours.nearest(df.unionByName(df.limit(5))).collect():
        got[r.chunk_id][r.near_chunk_id] = r.cosine
    assert len(got) == 70 and all(len(v) == 5 and k not in v for k, v in got.items())
    assert all(abs(c - 1) < 1e-3 for k in ("k000000", "k000039") for c in got[k].values())
    assert neighbours.nearest(df.limit(0)).count() == 0
    pairs = neighbours.neighbour_pairs(neighbours.nearest(df)).collect()
    assert all(r.chunk_id_a < r.chunk_id_b for r in pairs)


def test_multi_sequence_is_in_order():
    d1, d2 = [0.0, 1.0, 4.0], [0.0, 2.0, 3.0]
    got = neighbours.multi_sequence(d1, d2, 9)
    sums = [d1[a] + d2[b] for a, b in got]
    assert sums == sorted(sums) and len(set(got)) == 9


def test_walk_goes_on_until_enough_entries():
    """Empty cells cost no entries: the walk passes over them, and more rows ask for more entries."""
    d = [float(i) for i in range(40)]
    held = lambda i, j: 10 * (i + j >= 12)  # noqa: E731 the 78 nearest pairs are empty
    got = neighbours.multi_sequence(d, d, 200, held)
    assert len(got) == 20 and all(i + j >= 12 for i, j in got)
    assert neighbours.multi_sequence(d[:2], d[:2], 200, held) == []
    draw = np.random.default_rng(2)
    x, c1, c2 = draw.normal(size=(50, 8)).astype(np.float32), draw.normal(size=(30, 4)).astype(np.float32), draw.normal(size=(30, 4)).astype(np.float32)
    sizes = np.where(np.arange(900) % 9 == 0, 20, 0)  # eight of nine cells are empty
    for by in neighbours._visits(x, c1, c2, 500, sizes, np.arange(30) // 5):
        assert sum(sizes[c] for cells in by.values() for c in cells) >= 500 and len({g for g in by}) <= 6
    assert neighbours.entries_wanted(1_788_430) > 3 * neighbours.entries_wanted(178_843) > 3 * 640


def test_large_groups_of_entries_are_cut(spark, monkeypatch):
    draw = np.random.default_rng(4)
    df = spark.createDataFrame([(f"c{i:03d}", draw.normal(size=96).tolist(), None) for i in range(400)], "chunk_id string, embedding array<double>, created_at timestamp")
    whole = {tuple(r) for r in neighbours.nearest(df).select("chunk_id", "near_chunk_id").collect()}
    monkeypatch.setattr(neighbours, "PART_ROWS", 20)
    assert {tuple(r) for r in neighbours.nearest(df).select("chunk_id", "near_chunk_id").collect()} == whole and len(whole) == 2000


# --- 3 -------------------------------------------------------------------------------------------


def jaccard(a, b):
    def runs(t):
        w = words(t)
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x | y else float(a.strip() == b.strip())


def brute_repeats(data):
    """(document, batch) -> possible kept documents, batch by batch."""
    accepted, out = [], {}
    for seq in sorted({r[1] for r in data}):
        new = []
        for doc, s, h, text in sorted({r for r in data if r[1] == seq}, key=str):
            near = [d for d, h2, t2 in accepted if (h and h == h2) or (text is not None and t2 is not None and jaccard(text, t2) >= 0.5)]
            if near and text is not None:
                out[doc, f"b{s}"] = set(near)
            else:
                new.append((doc, h, text))
        accepted += new
    return out


def corpus(n=60, seed=0):
    draw = np.random.default_rng(seed)
    vocabulary = [f"kata{i}" for i in range(400)]
    base = [" ".join(draw.choice(vocabulary, 60)) for _ in range(12)]
    data = []
    for i in range(n):
        w = base[draw.integers(0, 12)].split()
        for _ in range(draw.integers(0, 14)):
            w[draw.integers(0, len(w))] = str(draw.choice(vocabulary))
        data.append((f"d{i}", int(draw.integers(1, 6)), f"h{i}", " ".join(w)))
    data += [(d, 6, h, t.upper()) for d, _, h, t in data[:5]]  # recrawls
    data += [("null", 1, "hn", None), ("null2", 2, "hn", None), ("same", 3, "hn", "teks yang lain sekali di sini"), ("e1", 1, None, ""), ("e2", 2, None, ""), ("s1", 1, None, "dua kata"), ("s2", 2, None, "Dua kata!"), ("s2", 2, None, "Dua kata!")]
    return data


def tables(spark, data):
    c = spark.createDataFrame([(d, f"b{s}", h, t, s) for d, s, h, t in data], "document_id string, crawl_batch_id string, content_hash string, content string, seq int")
    b = spark.createDataFrame([(f"b{s}", s) for s in range(1, 7)], "crawl_batch_id string, batch_seq bigint")
    return c, b


@pytest.mark.parametrize("arrivals", [1, 3])
def test_repeats_against_brute_force(spark, tmp_path, arrivals):
    data = corpus()
    got = {(r.document_id, r.crawl_batch_id): r.kept_document_id for r in batches.repeats(*tables(spark, data), folder(tmp_path), arrivals).collect()}
    want = brute_repeats(data)
    assert got.keys() == want.keys()
    assert all(got[k] in want[k] for k in want)
    assert ("null2", "b2") not in got and got["same", "b3"] == "null" and got["e2", "b2"] == "e1" and got["s2", "b2"] == "s1"


def test_history_batch_by_batch(spark, tmp_path):
    data = corpus(30, seed=4)
    c, _ = tables(spark, data)
    history, got = batches.History(spark, f"file://{tmp_path}"), {}
    for s in range(1, 7):
        for r in history.take(c.where(f"seq = {s}")).collect():
            got[r.document_id, r.crawl_batch_id] = r.kept_document_id
        if s == 3:
            history.compact()
    want = brute_repeats(data)
    assert got.keys() == want.keys() and all(got[k] in want[k] for k in want)


def test_one_page_in_every_batch(spark, tmp_path):
    """Copies, and pages that differ in a counter, hold all rows: each later one repeats the first."""
    text = " ".join(f"perkataan{i}" for i in range(80))
    data = [(f"d{i:03d}", 1 + i // 20, None, f"{text} paparan {i % 50}") for i in range(120)]
    got = batches.repeats(*tables(spark, data), folder(tmp_path), 2).collect()
    assert len(got) == 100 and all(r.kept_document_id < "d020" for r in got)
    empty, b = tables(spark, data[:1])
    assert batches.repeats(empty.limit(0), b, folder(tmp_path, "none"), 2).count() == 0


def template_family(n=300, seed=5):
    """Pages of one template, each repeated once in a later batch: a page is like all others, but near to its own repeat only."""
    draw = np.random.default_rng(seed)
    shared = [f"templat{i}" for i in range(110)]
    data = []
    for i in range(n):
        own = [f"isi{i}x{k}" for k in range(60)]
        for seq in (1, 2):
            w = [*shared, *own]
            for at in draw.choice(len(w), 7, replace=False):
                w[at] = f"lain{i}x{seq}x{at}"
            data.append((f"d{i:04d}" + "r" * (seq - 1), seq, f"h{i}-{seq}", " ".join(w)))
    return data


@pytest.mark.parametrize("hot", [batches.HOT, 50])
def test_repeats_in_a_template_family(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(batches, "HOT", hot)
    data = template_family()
    got = {(r.document_id, r.crawl_batch_id): r.kept_document_id for r in batches.repeats(*tables(spark, data), folder(tmp_path), 2).collect()}
    want = {(d, "b2"): d[:-1] for d, s, _, t in data if s == 2 and jaccard(t, next(x[3] for x in data if x[0] == d[:-1])) >= 0.5}
    assert len(want) > 250 and got.keys() >= want.keys()
    text = {d: t for d, _, _, t in data}
    assert all(jaccard(text[d], text[k]) >= 0.5 for (d, _), k in got.items())


def test_a_run_leaves_nothing_out_unsaid():
    """Whatever is handed on with few only is named; with enough, all pairs that look near are handed on."""
    draw = np.random.default_rng(8)
    lanes = draw.integers(0, 16, (700, batches.LANES)).astype(np.uint8)
    lanes[:600, :30] = 3  # all look near to one another
    lanes[300:310] = lanes[650]
    fresh, side = draw.random(700) < 0.6, np.zeros(700, np.int64)
    equal = (lanes[:, None, :] == lanes[None, :, :]).sum(axis=2) >= batches.SKETCH_LANES
    want = {(a, b) for a, b in zip(*np.nonzero(equal), strict=True) if a < b and (fresh[a] or fresh[b])}
    a, b, out = batches._run(lanes, fresh, side, 10_000)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and not len(out)
    a, b, out = batches._run(lanes, fresh, side, 8)
    got, said = set(zip(a.tolist(), b.tolist(), strict=True)), set(out.tolist())
    assert got <= want and all(p in got or said & set(p) for p in want) and len(got) < 700 * 9
    side = np.arange(700) % 2
    a, b, _ = batches._run(lanes, fresh, side, 10_000)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {p for p in want if side[p[0]] != side[p[1]]}


def test_window_crosses_keys_of_a_prefix():
    lanes = np.zeros((4, batches.LANES), np.uint8)
    key = np.array([(7 << 32) | 1, (7 << 32) | 2, (7 << 32) | 9, (8 << 32) | 1])
    got = {(int(x), int(y)) for a, b in batches._window(key, lanes, np.array([False, False, True, True])) for x, y in zip(a, b, strict=True)}
    assert got == {(0, 2), (1, 2)}


@pytest.mark.parametrize("short", [True, False])
def test_pages_of_short_lines(spark, tmp_path, short):
    """Pairs at the similarity, that share 40 short lines and differ in the rest: keys come from the whole text."""
    data = []
    for i in range(50):
        same = "\n".join(f"baris {i} nombor {k} pendek" for k in range(40))
        for seq in (1, 2):
            rest = [f"lain{i}x{seq}x{k}" for k in range(40)]
            data.append((f"d{i}-{seq}", seq, None, same + "\n" + ("\n" if short else " ").join(rest)))
    got = {r.document_id: r.kept_document_id for r in batches.repeats(*tables(spark, data), folder(tmp_path), 2).collect()}
    assert got == {f"d{i}-2": f"d{i}-1" for i in range(50)}


def test_history_goes_on_after_a_restart(spark, tmp_path):
    data = corpus(30, seed=9)
    c, _ = tables(spark, data)
    got = {}
    for s in range(1, 7):
        history = batches.History(spark, folder(tmp_path), most_parts=2)  # a new object each time
        for r in history.take(c.where(f"seq = {s}")).collect():
            got[r.document_id, r.crawl_batch_id] = r.kept_document_id
    want = brute_repeats(data)
    assert got.keys() == want.keys() and all(got[k] in want[k] for k in want)
    assert len(history.state.parts("keys")) <= 3


# --- 4 -------------------------------------------------------------------------------------------


def lines_table(spark, docs):
    return spark.createDataFrame([(f"d{i}", s, c, "x") for i, (s, c) in enumerate(docs)], "document_id string, source_name string, content string, line_key string")


def test_repeated_lines(spark, tmp_path):
    docs = [("A", f"Hak  Cipta {i}\r\nbiasa {chr(97 + i)}\n123") for i in range(6)] + [("B", "Hak Cipta 1")] * 4 + [(None, "Hak Cipta 1"), ("A", None), ("A", "")]
    df = lines_table(spark, docs)
    found = repeated_lines.repeated_lines(df, folder(tmp_path))
    assert rows(found, "source_name", "line_key", "n_docs", "n_source_docs") == [("A", "hak cipta #", 6, 8)]
    clean = repeated_lines.rebuild(df, found, ["document_id"]).collect()
    assert len(clean) == 6 and all("Cipta" not in r.content and r.content.endswith("\n123") for r in clean)
    assert repeated_lines.repeated_lines(df.limit(0), folder(tmp_path, "none")).count() == 0


def test_line_state_goes_on(spark, tmp_path):
    docs = [("A", "satu baris\nlain " + str(i)) for i in range(7)]
    whole = lines_table(spark, docs)
    a, b = whole.where("document_id < 'd4'"), whole.where("document_id >= 'd3'")  # d3 comes again
    state = repeated_lines.LineCounts(spark, folder(tmp_path), most_parts=1)
    assert state.take(repeated_lines.line_delta(a))[0].count() == 0
    state = repeated_lines.LineCounts(spark, folder(tmp_path), most_parts=1)  # a restart; parts are compacted
    newly, fallen = state.take(repeated_lines.line_delta(b))
    assert newly.count() == 2 and fallen.count() == 0 and len(state.state.parts("counts")) == 1
    assert rows(repeated_lines.spell_out(whole, state.crossed()), "line_key", "n_docs") == [("lain #", 7), ("satu baris", 7)]
    assert rows(state.counts(), "n_docs") == [(7,), (7,), (7,)]


def test_only_documents_with_newly_crossed_or_fallen_lines_are_rebuilt(spark, tmp_path):
    first = lines_table(spark, [("A", f"lama\nisi {chr(97 + i)}") for i in range(5)] + [("A", f"baru\nteks {chr(107 + i)}") for i in range(4)])
    state = repeated_lines.LineCounts(spark, folder(tmp_path))
    newly, _ = state.take(repeated_lines.line_delta(first))
    assert rows(repeated_lines.rebuild(first, repeated_lines.spell_out(first, state.crossed()), ["document_id"], state.holders(newly)), "document_id") == [(f"d{i}",) for i in range(5)]
    more = spark.createDataFrame([("e0", "A", "baru\nlagi")], "document_id string, source_name string, content string")
    newly, fallen = state.take(repeated_lines.line_delta(more))
    every = first.drop("line_key").unionByName(more)
    lines = repeated_lines.spell_out(every, state.crossed())
    got = repeated_lines.rebuild(every, lines, ["document_id"], state.holders(newly)).collect()
    assert sorted(r.document_id for r in got) == ["d5", "d6", "d7", "d8", "e0"] and all(r.n_removed == 1 for r in got)
    # the source grows until its lines fall below the share
    many = spark.range(120).select(F.concat(F.lit("f"), "id").alias("document_id"), F.lit("A").alias("source_name"), F.concat(F.lit("x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("content"))
    newly, fallen = state.take(repeated_lines.line_delta(many))
    assert newly.count() == 0 and fallen.count() == 2
    back = repeated_lines.rebuild(every, repeated_lines.spell_out(every, state.crossed()), ["document_id"], state.holders(fallen)).collect()
    assert len(back) == 10 and all(r.n_removed == 0 and ("lama" in r.content or "baru" in r.content) for r in back)


# --- 5 -------------------------------------------------------------------------------------------

PROSE = ["Perkara pertama yang perlu difahami ialah bahawa jual beli itu harus pada asalnya.", "The early endowment copies the prostration for a continuous alms and offering.", "Sebagian nikah mengutamakan azan tanpa gadai serta menyentuh aurat berat sejak pedagang."] * 30


def test_residue():
    m = residue.Models(PROSE)
    kind = lambda t, c: residue.classify(t, c, m)
    body = "\n".join(PROSE[:6])
    assert kind("Tajuk", body) is None and kind(None, None) is None and kind("", "") is None
    for p in ("{{ tajuk }}", "<%= tarikh %>", "${page.heading}", "%pautan%", "[[nama]]", "{% block x %}", "@@page.isi@@", "##PAGE.HEADING##", "[Masukkan tajuk]"):
        assert kind("x", body.replace("harus", p, 1)) == "placeholder", p
        assert kind(p, body) == "placeholder"
    for ok in ("[Khas] Hukum", "100% halal dan 50% susu", "Medan {…} kosong", "siri {2}", "[pautan](https://a.example)"):
        assert kind(ok, f"{body}\n{ok}") is None, ok
    assert kind("x", body + "\nLorem ipsum dolor sit amet elit sed tempor nostrud") == "filler"
    assert kind("x", "Utama | Video | Carian\n404 Not Found\nTag: a, b") == "notice"
    assert kind("x", f"{body}\n404 Not Found") is None
    assert kind("Untitled Document", body) == "placeholder"
    assert kind("x", body.upper() + " $ 3,116.50 AND 50% OF IT") is None


@pytest.mark.parametrize("said", ["This account has been suspended", "Your browser is not supported", "Cookies must be enabled", "Bandwidth limit exceeded", "HTTP Error 410", "Seite nicht gefunden", "الصفحة غير موجودة", "页面不存在", "Not found: /a/b-c", "404 Page not found /x/y.html"])
def test_notices_of_other_words(said):
    m, body = residue.Models(PROSE), "\n".join(PROSE[:6])
    assert residue.classify("x", said, m) == "notice"
    assert residue.classify("x", f"{body}\n{said}", m) is None  # beside an article


@pytest.mark.parametrize("mark", ["<<first_name>>", "{first_name}", "#{title}", "*|FNAME|*", "[% title %]", "[Sila masukkan nama penulis]", "{{ nama penuh " + "x" * 200 + " }}"])
def test_placeholders_of_other_marks(mark):
    m, body = residue.Models(PROSE), "\n".join(PROSE[:6])
    assert residue.classify("x", body.replace("harus", mark, 1), m) == "placeholder"
    assert residue.classify(mark, body, m) == "placeholder"


def test_talk_about_residue_is_none():
    m = residue.Models(PROSE)
    said = "Ralat 404 dan halaman tidak dijumpai dibincangkan kerana laman wakaf itu pernah mengalaminya pada tahun lalu."
    assert residue.classify("Halaman tidak dijumpai: apa maksudnya", "\n".join([*PROSE[:6], said]), m) is None
    assert residue.classify("Hukum skrip", "\n".join([*PROSE[:6], said]), m) is None


def test_rows_are_classified_together(monkeypatch):
    m, body = residue.Models(PROSE), "\n".join(PROSE[:6])
    odd = [("x", "404 Not Found"), ("{{ nama }}\nx", body), ("Lorem ipsum dolor sit amet\nelit sed", body), ("x", f"{body}\n[Masukkan tajuk]"), ("x", f"{body}\nLorem ipsum dolor sit amet elit sed tempor nostrud"), ("Untitled\n", body), ("x", "Not found: /a/b-c"), ("x", f"Not found: /a/b-c\n{body}")]
    rows = [x for o in odd for x in (o, *[("Hukum wakaf", f"{body}\n* [a](b) {{c}} 12/3\n\n")] * 40, (None, None), ("", ""), ("x", "lorem ipsum dolor"), ("x", "sit amet elit sed"))]
    alone = [residue.classify(t, c, m) for t, c in rows]
    assert [alone[k * 45] for k in range(len(odd))] == ["notice", "placeholder", "filler", "placeholder", "filler", "placeholder", "notice", None]
    calls, hashed = [], residue._hashed
    monkeypatch.setattr(residue, "_hashed", lambda *a: calls.append(1) or hashed(*a))
    assert residue.classify_all([t for t, _ in rows], [c for _, c in rows], m) == alone
    assert len(calls) < len(rows) / 3  # a few passes over many rows, not some for each


def test_bounds_leave_nothing_out(monkeypatch):
    texts = [*PROSE[:40], *residue.FILLER, *residue.NOTICES, "404 not found " * 40, "lorem ipsum " * 300]
    whole = residue.Models(texts)
    monkeypatch.setattr(residue, "TOO_LONG", 1)  # every line is summed exactly
    exact = residue.Models(texts)
    for a, b in zip([*whole.fillers, whole.notice, whole.titles, whole.unfilled, whole.marks], [*exact.fillers, exact.notice, exact.titles, exact.unfilled, exact.marks], strict=True):
        assert (a == b).all()


def test_residue_table(spark):
    df = spark.createDataFrame([("a", "b", "{{x}}", "teks", 1), ("a", "b", "{{x}}", "teks", 1), ("n", "b", None, None, 1)], "document_id string, crawl_batch_id string, title string, content string, kind int")
    assert rows(residue.residue(df), "document_id", "kind") == [("a", "placeholder")]
    assert residue.residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [[f"Perkara {chr(97 + k % 26)}{chr(97 + k // 26 % 26)} yang sah" for k in range(4_000)], ["\n".join(f"Baris {chr(97 + k % 26)}{chr(97 + k // 26)} itu" for k in range(100))], ["Zakat itu wajib.", "harta wakaf " * 500]], ids=["rows", "lines", "long line"])
def test_prose_is_fitted_on_all_lines(spark, texts):
    df = spark.createDataFrame([(str(k), "b", x) for k, x in enumerate([*texts, None, ""])], "document_id string, crawl_batch_id string, content string")
    m, whole = residue.fit(df.repartition(3)), residue.Models([x for t in texts for x in t.split("\n")])
    for a, b in zip([*m.fillers, m.notice, m.titles, m.unfilled, m.marks], [*whole.fillers, whole.notice, whole.titles, whole.unfilled, whole.marks], strict=True):
        assert (a == b).all()
    grams = residue._grams(residue._plain(texts[-1].split("\n")[-1]))
    assert m.notice[grams].mean() < -1  # the last line has been seen


def test_grams_are_counted_line_by_line():
    texts = [*PROSE[:3], "A.B c_d 12.5a v2 KATA", "\n 1_\r\n\n## Tajuk 2024-10\t x \u00a0 y\nab", "_", "__NAMA__ {{ x }}\n\u0643\u0650\u062a", "Σας ΑΣ\n字", None, ""]
    grams, shapes = residue.count_grams(texts)
    lines = [x for t in texts if t for x in t.split("\n")]
    count = lambda found: np.bincount(np.concatenate(found), minlength=len(grams))
    assert (grams == count([residue._grams(residue._plain(x)) for x in lines])).all()
    assert (shapes == 4 * count([residue._shape_grams(f" {x} ") for x in lines]) + count([residue._shape_grams(f" {x.upper()} ") for x in lines])).all()


# --- 6 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["x" * 5000, "kata " * 900, "Ayat satu. " * 400, ("para satu dua tiga. " * 20 + "\n\n") * 12, "字" * 3000 + "。" + "文" * 2000, "é" * 2000])
def test_pieces(text):
    pieces = splitting.bisect_text(text)
    assert "".join(text[c:e] for _, c, e in pieces) == text
    assert all(e - s <= 1200 and 0 <= c - s <= 200 for s, c, e in pieces)
    assert all(s < c for s, c, _ in pieces[1:])
    if "." in text:
        assert all(text[e - 1].isspace() for _, _, e in pieces[:-1])


def test_pieces_small():
    assert splitting.bisect_text("") == [] and splitting.bisect_text("a" * 1200) == [(0, 0, 1200)]
    assert len(splitting.bisect_text("a" * 1201)) == 2
    text = "a" * 700 + "\n\n" + "b" * 700
    assert splitting.bisect_text(text, 1200, 0) == [(0, 0, 702), (702, 702, 1402)]


def test_pieces_table(spark):
    df = spark.createDataFrame([("a", "x " * 1000, 7), ("b", "kecil", 8), ("n", None, 9), ("e", "", 9)], "chunk_id string, content string, chunk_index int")
    got = splitting.split_oversized(df, ["chunk_id"], "content").collect()
    assert {r.chunk_id for r in got} == {"a", "b"} and sorted(r.chunk_index for r in got if r.chunk_id == "a") == list(range(sum(r.chunk_id == "a" for r in got)))
    assert splitting.split_oversized(df.limit(0), ["chunk_id"], "content").count() == 0


@pytest.mark.parametrize("said", ["a " * 200 + "x" * 1000 + " b" * 200, "kata " * 60 + "y" * 620 + " " + "kata " * 60, "x" * 1000 + " " + "y" * 1000])
def test_no_word_is_cut_where_pieces_can_end_between_words(said):
    for start, core, end in splitting.bisect_text(said):
        assert end - start <= 1200 and (core == 0 or said[core - 1] == " " or said[core] == " ")


def test_a_run_too_long_for_a_piece_is_cut_only_inside():
    said = "satu dua " * 20 + "z" * 3000 + " tiga empat" * 20
    cuts = [c for _, c, _ in splitting.bisect_text(said)][1:]
    assert all(said[c - 1] == said[c] == "z" or " " in said[c - 1 : c + 1] for c in cuts)
    assert sum(said[c - 1] == said[c] == "z" for c in cuts) >= 2


# --- 7 -------------------------------------------------------------------------------------------


def test_leaks(spark):
    draw = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(30)]  # few words: many false starts
    items = [(i, " ".join(draw.choice(vocabulary, 40))) for i in range(8)] + [(98, "pendek sahaja"), (99, None)]
    docs = []
    for d in range(60):
        w = list(draw.choice(vocabulary, 200))
        if d % 3 == 0:
            q = items[d % 8][1].split()
            a, n = int(draw.integers(0, 25)), int(draw.integers(9, 16))
            at = int(draw.integers(0, 180))
            w[at : at + n] = q[a : a + n]
        docs.append((d, " ".join(w).replace(" ", ",\n", 3)))
    docs += [(100, items[0][1].upper()), (101, None), (102, ""), (100, items[0][1])]
    x = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("terms", F.lit(1))
    y = spark.createDataFrame(items, "item_id bigint, item_text string")
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 11):
            grams[tuple(w[k : k + 12])].add(i)
    want = sorted({(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - 11) for i in grams[tuple(w[k : k + 12])]})
    index = leakage.build_index(x, segment_tokens=1500)
    assert want and rows(leakage.search_index(index, y), "doc_id", "item_id") == want
    near = rows(leakage.search_index(index, y, slop=3), "doc_id", "item_id")
    assert set(want) <= set(near)
    gap = " ".join([*items[1][1].split()[:8], "sisip", *items[1][1].split()[8:16]])
    index = leakage.build_index(spark.createDataFrame([(5, gap)], "doc_id bigint, text string"))
    assert leakage.search_index(index, y).count() == 0 and rows(leakage.search_index(index, y, slop=3), "item_id") == [(1,)]
    assert leakage.search_index(leakage.build_index(x.limit(0)), y).count() == 0
    assert leakage.search_index(index, y.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    text = " ".join(f"kata{k}" for k in range(30))
    docs = spark.createDataFrame([("dok-a", text), ("dok-b", "lain"), (None, text)], "doc_id string, text string")
    items = spark.createDataFrame([("soalan", text), ("pendek", "kata1")], "item_id string, item_text string")
    for slop in (None, 6):
        assert rows(leakage.search_index(leakage.build_index(docs), items, slop=slop), "doc_id", "item_id") == [("dok-a", "soalan")]


def test_phrase_lists_against_brute_force(spark):
    """Small vocabularies make long lists: every run of at least 12 words is found, and no other."""
    draw = np.random.default_rng(2)
    texts = [[f"w{x}" for x in draw.integers(0, 6, 400)] for _ in range(40)]
    item = texts[3][50:90]
    for d in (7, 8):
        texts[d][100:112] = item[5:17]
    texts[9][100:111] = item[5:16]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, item_text string")
    runs = {tuple(item[k : k + 12]) for k in range(len(item) - 11)}
    want = [(i,) for i, t in enumerate(texts) if any(tuple(t[k : k + 12]) in runs for k in range(len(t) - 11))]
    assert rows(leakage.search_index(leakage.build_index(docs, segment_tokens=900), items), "doc_id") == want
    assert {(3,), (7,), (8,)} <= set(want)


# --- 8 -------------------------------------------------------------------------------------------


def mix_tables(spark):
    sizes = [(i, "a", 10) for i in range(1000)] + [(1000 + i, "b", 10) for i in range(30)] + [(2000 + i, "c", 7) for i in range(100)]
    s = spark.createDataFrame(sizes, "doc_id bigint, source string, n_tokens bigint").withColumn("weight", F.lit(1.0))
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.2, 2), ("c", 0.2, 4), ("none", 0.1, 5)], "source string, target_share double, max_repeats bigint")
    return s, t


def test_mix(spark):
    s, t = mix_tables(spark)
    plan = mixing.plan_mix(s, t)
    assert rows(plan.where("NOT reachable"), "source") == [("b",), ("none",)]
    mix = mixing.draw_mix(s, plan)
    got = {r.source: r for r in mixing.report_shares(mix, plan).collect()}
    total = 11_000
    assert got["a"].mixed_tokens == 5500 and got["b"].mixed_tokens == 600 and got["none"].mixed_tokens == 0
    assert 0.2 * total - 7 < got["c"].mixed_tokens <= 0.2 * total
    assert got["c"].most_repeats <= 4 and abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    # whole epochs come first: repeats of a source differ by one at most
    per = defaultdict(set)
    for r in mix.collect():
        per[r.source].add(r.repeats)
    assert all(max(v) - min(v) <= 1 for v in per.values())
    # the partial epoch is the prefix by key that a sort of the whole source gives
    chosen = {r.doc_id for r in mix.where("source = 'a'").collect()}
    keyed = s.where("source = 'a'").select("doc_id", mixing.es_key(F.col("doc_id"), F.col("weight")).alias("k")).orderBy("k").limit(550)
    assert chosen == {r.doc_id for r in keyed.collect()}


def test_weights_pull(spark):
    s, t = mix_tables(spark)
    s = s.withColumn("weight", F.when(F.col("doc_id") % 2 == 0, 10.0).otherwise(1.0))
    chosen = [r.doc_id for r in mixing.draw_mix(s, mixing.plan_mix(s, t)).where("source = 'a'").collect()]
    assert sum(d % 2 == 0 for d in chosen) > 0.7 * len(chosen)
    nothing = s.limit(0)
    assert mixing.draw_mix(nothing, mixing.plan_mix(nothing, t)).count() == 0


@pytest.mark.parametrize("weight", [1e-6, 0.001, 1.0, 1000.0, None])
def test_no_key_bucket_is_large_at_any_scale_of_weights(spark, weight):
    keys = spark.range(50_000).select(F.floor(F.log2(mixing.es_key(F.col("id"), F.lit(weight).cast("double"))) * mixing.OCTAVE).alias("b"))
    assert keys.groupBy("b").count().agg(F.max("count")).first()[0] < 0.01 * 50_000


@pytest.mark.skipif(not TOKENIZERS, reason="no tokenizer here")
def test_tokens(spark):
    df = spark.createDataFrame([(1, "zakat dan wakaf"), (2, None), (3, "")], "doc_id bigint, text string").withColumn("t", F.lit(0))
    got = dict(rows(mixing.count_tokens(df, ["doc_id"], "text"), "doc_id", "n_tokens"))
    assert got[1] > 3 and got[2] == got[3] == 0


# --- 9 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "said",
    [
        ["Prof. Madya Dr. Hj. A bin B berkata demikian.", "Ia mudah, murah dll.", "Mereka pulang?!", "Sabda S.A.W. menjadi sandaran (lihat hlm. 3, Jil. 2, No. 4).", '"Satu sahaja. Dua juga," kata Tahir.', "“Apa?” tanya Laila kepada Salma.", 'Guru menjawab: "Satu. Dua."', "Kadar 5.24 peratus di yuden.example untuk kita ... lagi."],
        ["The class starts at 7 p.m. and ends, e.g. when i.e. done.", "Mr. X wrote it (is it so?).", "A. R. Smith said ok."],
        ["أجاب الشيخ: «الأول هنا. الثاني هناك.»", "«هل هذا؟» سأل الطالب.", "قال د. الجار إن ذلك (ص. ٤٣، ج. ٢).", "المقدار ٢٫٥ في المائة!"],
        ["مسجد صحیح ہے۔", "ڈاکٹر نے کہا: ”نذر کے بعد۔ سجدہ کے بعد۔“", "شرح 8.34 فیصد ہے؟"],
    ],
)
def test_sentences_with_spaces(said):
    for gap in (" ", "  ", "\n", "\n\n", " \n \n"):
        text = gap.join(said)
        assert [text[a:b] for a, b in sentences.sentence_spans(text)] == said


def test_sentences_of_other_scripts():
    said = ["老师说：“甲来了。乙走了。”", "比例为1.19%，丙（见第27页。）。", "“丁？”学生问。", "戊……己！"]
    text = "".join(said)
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == said
    thai = "ข้าวใหม่ 2.13 เปอร์เซ็นต์ มรดกเก่า ถ้าน้ำ 20 คนทอง"
    assert [thai[a:b] for a, b in sentences.sentence_spans(thai)] == ["ข้าวใหม่ 2.13 เปอร์เซ็นต์", "มรดกเก่า", "ถ้าน้ำ 20 คนทอง"]


@pytest.mark.parametrize("n", [2, 10, 60, 200])
def test_a_quotation_is_one_sentence_whatever_its_length(n):
    said = " ".join(f"Ayat nombor {i} dibaca oleh jemaah." for i in range(n))
    for text in (f'"{said}" kata imam itu. Kemudian dia pulang.', f'Imam itu berkata: "{said}" Kemudian dia pulang.'):
        spans = sentences.sentence_spans(text)
        assert len(spans) == 2 and text[slice(*spans[1])] == "Kemudian dia pulang."
    bracketed = f"Tiga perkara ({said}) disebut. Kemudian dia pulang."
    assert len(sentences.sentence_spans(bracketed)) == 2
    # a mark without a partner holds nothing together
    assert len(sentences.sentence_spans(f'Dia "pulang. {said}')) == n + 1


def test_lengths_decide_where_a_closing_word_is_ambiguous():
    short, long = "Foo Inc. Bar.", "The firm is named Foo Trading Inc. Its owners left the town in spring."
    assert len(sentences.sentence_spans(short)) == 1 and len(sentences.sentence_spans(long)) == 2


def test_best_spans_equal_an_exhaustive_search():
    draw = np.random.default_rng(3)
    for _ in range(40):
        at = np.sort(draw.choice(np.arange(1, 400), 9, replace=False)).tolist()
        found = [(p, float(draw.normal(0, 1))) for p in at]

        def value(chosen):
            ends = [0, *(p for p, _ in chosen), 400]
            return sum(s for _, s in chosen) - sum(sentences._length(b - a) for a, b in zip(ends, ends[1:], strict=False))

        every = [[found[i] for i in range(9) if m >> i & 1] for m in range(512)]
        got = set(sentences._best(0, 400, found))
        assert value([c for c in found if c[0] in got]) == pytest.approx(max(map(value, every)))


def test_sentences_edges():
    f = lambda t: [t[a:b] for a, b in sentences.sentence_spans(t)]
    assert f(None) == f("") == f(" \n\n ") == []
    assert f("Tajuk tanpa titik\n\n1. Satu perkara.\n2. Dua perkara\n3. Tiga.") == ["Tajuk tanpa titik", "1. Satu perkara.", "2. Dua perkara", "3. Tiga."]
    assert f("Baris yang\ndipotong keras. Ayat.") == ["Baris yang\ndipotong keras.", "Ayat."]
    assert f("Satu.Dua perkara lagi.") == ["Satu.", "Dua perkara lagi."]
    long = "Ayat ini panjang. " * 20000
    assert len(sentences.sentence_spans(long)) == 20000
    odd = 'Satu "dua. Tiga. Empat. ' + "Lima lagi. " * 50
    spans = sentences.sentence_spans(odd)
    assert "".join("".join(odd[a:b].split()) for a, b in spans) == "".join(odd.split()) and len(spans) > 40


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, "")], "doc_id bigint, text string").withColumn("k", F.lit(1)).withColumn("sentence", F.lit("x"))
    assert rows(sentences.sentences(df), "doc_id", "sentence_no", "sentence") == [(1, 0, "A b."), (1, 1, "C d.")]
    assert sentences.sentences(df.limit(0)).count() == 0


# --- all -----------------------------------------------------------------------------------------

COLUMNS = {
    "p1_found": ["document_id", "crawl_batch_id", "line_no"], "p2_found": ["chunk_id_a", "chunk_id_b"], "p3_found": ["document_id", "crawl_batch_id", "kept_document_id"],
    "p4_found": ["source_name", "line_key"], "p5_found": ["document_id", "crawl_batch_id"], "p6_found": ["chunk_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["source"], "p9_found": ["doc_id", "start_pos", "end_pos"],
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, sf, name):
    if name.startswith("p8") and not TOKENIZERS:
        pytest.skip("no tokenizer here")
    df = registry.queries()[name](spark, sf)
    got = df.collect()
    assert got or name == "p6_chunk_pieces"
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(got) == len(set(got))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = registry.queries()[name](spark, sf)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
