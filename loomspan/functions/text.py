"""Text functions on columns: search normalisation, lemmas, keywords, matching, cleaning, chunking."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Domain vocabulary of the search normaliser (defaults of parameters).
ALIASES = {
    "feqah": "fiqh", "fekah": "fiqh", "fiqah": "fiqh", "fikah": "fiqh", "fikh": "fiqh",
    "syariat": "syariah", "shariah": "syariah", "sharia": "syariah", "syarak": "syariah",
    "hadis": "hadis", "hadith": "hadis", "hadist": "hadis", "sunnah": "sunnah", "sunah": "sunnah",
    "solat": "solat", "shalat": "solat", "sembahyang": "solat", "zakah": "zakat", "zakaat": "zakat",
    "ramadhan": "ramadan", "ramadzan": "ramadan", "iddah": "idah", "eddah": "idah", "idah": "idah",
}
PROTECTED = (
    "quran", "alquran", "hadis", "sunnah", "syariah", "fiqh", "zakat", "solat", "puasa", "ramadan", "idah", "nikah", "rujuk", "talak", "wakaf",
    "riba", "qiyas", "ijma", "ijtihad", "syafii", "jakim", "mufti",
)
SUFFIXES = (
    "nyakah", "nyalah", "kah", "lah", "pun", "nya", "kan", "an", "i",
)
PREFIXES = (
    "memper", "diper", "meng", "meny", "men", "mem", "ber", "ter", "per", "peng", "peny", "pen", "pem", "di", "ke", "se",
)
STOPWORDS = (
    "dan", "di", "ke", "yang", "adalah", "pada", "untuk", "atau", "saya", "apa", "apakah", "bagaimana", "ada", "tidak", "bila", "itu", "ini",
    "dengan", "oleh", "dari", "darihal", "tentang", "mengenai", "bagi", "seperti", "ia", "mereka", "kita", "kami", "kamu", "dia", "dalam",
    "sebagai", "akan", "telah", "sudah", "belum", "sedang", "boleh", "harus", "wajib", "hukum", "hukumnya", "status", "mengikut", "menurut",
    "keputusan", "fatwa", "kebangsaan", "malaysia", "pejabat", "mufti", "bagaimanakah", "siapa", "siapakah", "jawab", "ringkas", "sertakan",
    "asas", "rujukan", "sumber", "rasmi", "katalog", "berdasarkan",
)
NOISE_MARKERS = ("cookie", "privacy policy", "javascript", "enable cookies")
RULINGS = (
    "HARUS", "HARAM", "WAJIB", "SUNAT", "MAKRUH", "SAH", "BATAL",
)
# Fixed values end.

#: Unicode whitespace, for trimming; Java's \s and trim() know only ASCII.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _folding() -> tuple[str, str]:
    """Lower-case letters that NFKD takes to one ASCII letter or digit with marks, and those."""
    a, b = [], []
    for c in map(chr, [*range(0x80, 0x2500), *range(0xFF00, 0xFFF0)]):  # Latin, letter-like and full-width forms
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")
        if len(d) == 1 and d.isascii() and d.isalnum():
            a.append(c), b.append(d)
    return "".join(a), "".join(b)


_FROM, _TO = _folding()
_APOSTROPHES = "['\u2018\u2019`]"


def trim_all(c: Column) -> Column:
    """Trims Unicode whitespace."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def _unaccented(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(c), "[\u0300-\u036f]", ""), _FROM, _TO)


def _folded(c: Column) -> Column:
    return F.regexp_replace(_unaccented(c), _APOSTROPHES, "")


def normalize_text(c: Column) -> Column:
    """Lower case, accents and apostrophes dropped, everything but a-z and 0-9 made single spaces, trimmed.

    Accents fold by a table of one-letter NFKD results, inside the JVM; use :func:`normalize_text_exact` where
    ligatures must fold as well. Null stays null; texts of other scripts become empty.
    """
    return F.trim(F.regexp_replace(_folded(c), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def normalize_text_exact(s: pd.Series) -> pd.Series:
    """:func:`normalize_text` with full NFKD, in Arrow batches."""
    s = s.str.lower().str.normalize("NFKD").str.replace("[\u0300-\u036f]", "", regex=True).str.replace(_APOSTROPHES, "", regex=True)
    return s.str.replace("[^a-z0-9]+", " ", regex=True).str.strip()


def slugify(c: Column, fallback: str = "item", length: int = 80) -> Column:
    """Lower case, accents dropped, everything but a-z and 0-9 (apostrophes, too) made single hyphens, cut to ``length``;
    ``fallback`` where nothing is left."""
    s = F.substring(F.regexp_replace(F.regexp_replace(_unaccented(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def alias(word: Column, aliases: dict[str, str] = ALIASES) -> Column:
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.when(word.isin(list(aliases)), F.element_at(table, word)).otherwise(word)  # the map is searched for aliases only


# among suffixes that end alike the longer comes first in the list, so the lazy match takes the first that fits
_TAIL, _HEAD = "^(.{4,}?)(?:" + "|".join(SUFFIXES) + ")$", "^(?:" + "|".join(PREFIXES) + ")(.{4,})$"
_TAIL_RE, _HEAD_RE = re.compile(_TAIL), re.compile(_HEAD)


def _stem(base: Column) -> Column:
    keep = (F.length(base) <= 4) | base.isin(*PROTECTED)
    return F.when(keep, base).otherwise(F.regexp_replace(F.regexp_replace(base, _TAIL, "$1"), _HEAD, "$1"))


def lemma(word: Column) -> Column:
    """Light stemming: alias; unless protected or short, the first fitting suffix, then prefix, goes; alias again.

    A suffix or prefix fits if at least four letters stay. Lists are tried in order.
    """
    return alias(_stem(alias(word)))


def tokens(text: Column) -> Column:
    """Non-empty words of a text, normalised."""
    return F.filter(F.split(normalize_text(text), " "), lambda w: w != "")


def lemmas(text: Column) -> Column:
    return F.transform(F.transform(F.transform(tokens(text), lambda w: alias(w)), _stem), lambda w: alias(w))  # step by step: each is evaluated once


def normalized_query(text: Column) -> Column:
    return F.array_join(lemmas(text), " ")


def searchable(text: Column) -> Column:
    """The normalised text followed by its lemmas."""
    return F.trim(F.concat_ws(" ", normalize_text(text), F.array_join(lemmas(text), " ")))


def _lemma_of(word: str) -> str:
    """:func:`lemma` for one word, for the Arrow path: the same patterns."""
    base = ALIASES.get(word, word)
    stem = base if len(base) <= 4 or base in PROTECTED else _HEAD_RE.sub(r"\1", _TAIL_RE.sub(r"\1", base))
    return ALIASES.get(stem, stem)


class _Lemmas(dict):
    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = _lemma_of(word)
        return value


_LEMMAS = _Lemmas()


@F.pandas_udf(StringType())
def searchable_arrow(normalized: pd.Series) -> pd.Series:
    """A normalised text followed by its lemmas, in Arrow batches.

    Lambdas over arrays are interpreted word by word in the JVM and take tens of times as long on whole texts;
    here each distinct word is looked at once in a process.
    """
    return pd.Series([None if t is None else f"{t} {' '.join(map(_LEMMAS.__getitem__, t.split()))}".strip() for t in normalized], dtype="object")


def _normal_words(text: str) -> list[str]:
    """The words of :func:`normalize_text`, for a short text on the driver."""
    low = "".join(c for c in text.lower().translate(str.maketrans(_FROM, _TO)) if not "\u0300" <= c <= "\u036f")
    return re.findall("[a-z0-9]+", re.sub(_APOSTROPHES, "", low))


def matched_arrow(normalized: Column, words: list[str]) -> Column:
    """:func:`matched_keywords` of a fixed list of words, from the normalised text, in one pass of Arrow batches that
    gives back the matches only."""
    forms = [(k, f" {' '.join(map(_lemma_of, _normal_words(k)))} ") for k in words]
    forms = [(k, n) for k, n in forms if len(n) > 2]

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spoken = None if t is None else f" {t} {' '.join(map(_LEMMAS.__getitem__, t.split()))}".rstrip() + " "
            out.append([] if spoken is None else [k for k, n in forms if n in spoken])
        return pd.Series(out, dtype="object")

    return run(normalized)


def keywords(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct lemmas of more than three letters in order of appearance, less the stop words."""
    return F.array_distinct(F.filter(lemmas(text), lambda w: (F.length(w) > 3) & ~w.isin(*stopwords)))


def keyword_forms(words: Column) -> Column:
    """Keywords with what is looked for in a searchable text: structs of k and n."""
    return F.transform(words, lambda k: F.struct(k.alias("k"), F.concat(F.lit(" "), normalized_query(k), F.lit(" ")).alias("n")))


def matched_keywords(haystack: Column, words: Column, forms: Column | None = None) -> Column:
    """Those of ``words`` whose lemmatised form stands as whole words in the searchable ``haystack``."""
    padded = F.concat(F.lit(" "), haystack, F.lit(" "))
    forms = keyword_forms(words) if forms is None else forms
    return F.transform(F.filter(forms, lambda f: (F.length(f["n"]) > 2) & F.contains(padded, f["n"])), lambda f: f["k"])


def is_relevant(matches: Column, words: Column, long_word: int = 8, least: int = 2) -> Column:
    """One long match or several matches; everything is relevant to no words at all."""
    return F.exists(matches, lambda m: F.length(m) >= long_word) | (F.size(matches) >= least) | (F.size(words) == 0)


def truncate(c: Column, n: int) -> Column:
    """At most n characters, the last three of a cut text being dots."""
    return F.when(F.length(c) <= n, c).when(F.lit(n <= 3), F.substring(c, 1, n)).otherwise(F.concat(F.substring(c, 1, max(n - 3, 0)), F.lit("...")))


def compact_label(c: Column, n: int, placeholder: str = "-") -> Column:
    cut = F.when(F.length(c) <= n, c).otherwise(F.concat(F.trim(F.substring(c, 1, n - 1)), F.lit("...")))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(placeholder))


def compact_markdown(c: Column) -> Column:
    """Line ends made LF, runs of blank lines and blanks shortened, images dropped, trimmed."""
    for pattern, to in ((r"\r\n?", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"!\[[^\]]*\]\([^)]+\)", "")):
        c = F.regexp_replace(c, pattern, to)
    return trim_all(c)


def strip_html(c: Column) -> Column:
    """Script, style and svg blocks and comments dropped."""
    for tag in ("script", "style", "svg"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}>", "")
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def html_text(c: Column) -> Column:
    """Text of an HTML page: what :func:`strip_html` leaves, tags made spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_html(c), r"<[^>]*>", " "), r"\s+", " "))


def html_title(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def is_article(c: Column, min_chars: int = 450, short: int = 900) -> Column:
    """Long enough, and if shortish without a noise marker."""
    return (F.length(c) >= min_chars) & ((F.length(c) >= short) | ~F.lower(c).rlike("|".join(NOISE_MARKERS)))


def title_of(content: Column, *titles: Column, fallback: str = "") -> Column:
    """The first non-empty title, else the first line of over eight characters, cut to 180."""
    line = F.element_at(F.filter(F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"^[#\s]+|[#\s]+$", "")), lambda x: F.length(x) > 8), 1)
    first = F.coalesce(*[F.nullif(trim_all(t), F.lit("")) for t in titles], F.substring(F.try_element_at(F.filter(F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"^[#\s]+|[#\s]+$", "")), lambda x: F.length(x) > 8), F.lit(1)), 1, 180)) if titles else line
    return F.coalesce(first, F.lit(fallback))


def rulings(c: Column, words: list[str] = RULINGS) -> Column:
    """Ruling words of a text in order, upper case."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?i)\b({'|'.join(words)})\b"), 1), F.upper)


def yaml_string(c: Column) -> Column:
    escaped = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def paragraphs(c: Column, longer_than: int = 20) -> Column:
    """Trimmed lines of more than ``longer_than`` characters."""
    return F.filter(F.transform(F.split(c, r"\n+"), trim_all), lambda p: F.length(p) > longer_than)


def chunks(c: Column, size: int = 1200, longer_than: int = 20) -> Column:
    """Paragraphs packed greedily, in order, into chunks of at most ``size``; a longer paragraph is a chunk of its own.

    A fold inside the JVM: one pass, no shuffle. Null gives null, a text without such paragraphs an empty array.
    """
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        joined = F.concat(a["cur"], F.lit("\n"), p)
        empty, fits = a["cur"] == "", F.length(a["cur"]) + F.length(p) + 1 <= size
        return F.struct(
            F.when(empty, p).when(fits, joined).otherwise(p).alias("cur"),
            F.when(empty | fits, a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))).alias("out"),
        )

    return F.aggregate(paragraphs(c, longer_than), start, step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def first_body(*bodies: Column) -> Column:
    """The first of several renderings of a page that isn't blank; empty if all are."""
    return F.coalesce(*[F.when(F.trim(b) != "", b) for b in bodies], F.lit(""))
