"""Problem 1: the article of a crawled page among page furniture, by line-block distribution.

Markup is stripped and the lengths of the text outside links are summed over sliding windows of lines. Where the sums
surge over the page's own level text begins, where they dive below it text ends; what lies between is kept, a small
block far from the large one is not. Inside the surge's and the dive's windows lines decide: a headline above
belongs to the article, as do lines that read on below. What stands between and is short and no sentence is kept as a
subheading, unless its shape (a label, a date, a counter, nothing but links, a line repeated in the text) or one of the
openings listed below tells that it is furniture.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.partitions import spread

#: Lines (those without a letter left out) in a window.
BLOCK = 3
#: Where window sums surge and dive: this share of the page's level, and not below this text length.
LEVEL_SHARE, LEAST_SURGE = 0.3, 110
#: A line of at least this length that ends like a sentence is text; in pages without one the shorter length holds.
PARAGRAPH, SHORT_PARAGRAPH = 55, 40
#: Blocks with less text than this share of the largest block's are no part of the article.
MASS = 0.12
#: A line of at least this length is text, whatever it begins with.
LONG = 240
#: Lines that may stand between the dive and a line that reads on.
GAP = 2

_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_TAG = re.compile(r"<[a-zA-Z/!][^>\n]*>")
_BEFORE, _AFTER = " \t\r\xa0>#*_-•·", " \t\r\xa0*_#"
_LETTER = re.compile(r"[^\W_]")
_ENDED = re.compile(r"[.!?؟۔。！？…][\"'”’»)\]*_\s]*$")
_ITEM = re.compile(r"^\s*(?:[-*•+]\s+|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)]\s+)")
_MENU = re.compile(r"^[^.!?:]{1,40}(?:\s+(?:\||»|›|>|/|•|·|::)\s+[^.!?:]{1,40}){2,}$")
_CRUMB = re.compile(r"^(?:\S+ ){0,4}\S+\s+(?:›|»|>)\s+|^(?:anda di sini|you are here|anda berada di)\b", re.I)
_SEPARATED = re.compile(r"[|»›>/•·:](?::\s|(?<!:)\s)")  # in every menu, and in every crumb that no words open
_HERE = re.compile(r"anda di|you are|anda ber", re.I)

# How furniture lines begin or what they consist of (Malay, Indonesian, English).
_OPENINGS = """
oleh: | penulis: | ditulis oleh | disediakan oleh | disemak oleh | penyumbang: | suntingan: | disunting oleh | siri istimewa | siri khas | penyunting: | editor: | pengarang: | by: | written by | reviewed by | prepared by | author: | contributor:
dikemas kini | tarikh siaran | tarikh: | diterbitkan | disiarkan | terakhir dikemas | published | posted on | updated | last updated | last modified | diperbarui | tanggal: | date:
👁 | dibaca | jumlah paparan | paparan: | hits: | views: | dilihat | jumlah pembaca
tag: | tags: | kata kunci: | label: | topik: | keywords: | kategori: | category: | filed under
tel: | telefon: | tel. | faks: | fax: | e-mel: | email: | hubungi kami | contact us
penafian | disclaimer
kongsi artikel | kongsikan | sebarkan manfaat | sebarkan artikel | bagikan | share this | share on | share: | ikuti saluran | ikuti kami | follow us
subscribe | langgan | daftar untuk | newsletter | berlangganan
paling popular | terpopuler | terkini | artikel terkini | most popular | most read | trending | berita terkini | recent posts | popular posts
mungkin anda berminat | you may also like | anda mungkin juga suka | artikel berkaitan | related ( | artikel sebelum | artikel selepas | artikel seterusnya | related articles | related posts | artikel terkait
lihat juga | baca juga | baca: | read also | read more | see also | baca selanjutnya | seterusnya → | ← | sebelumnya | next: | previous: | » | «
teruskan membaca | continue reading | scroll to continue | sambung membaca
- iklan - | iklan | advertisement | sponsored | ditaja | sponsor
© | copyright | hak cipta terpelihara. | all rights reserved
sila log masuk untuk | login to post | log in to | ruangan komen | komen ditutup | comments are closed | tinggalkan komen | leave a comment | leave a reply | tiada komen
best viewed | paparan terbaik | sila aktifkan javascript | optimised for
langkau ke kandungan | terus ke kandungan | skip to | lompat ke kandungan | kembali ke atas | back to top | ke atas
laman ini menggunakan kuki | kami dan rakan kami menyimpan kuki | demi pengalaman anda, kuki | we use cookies | we and our partners | this site uses cookies | this website uses cookies | situs ini menggunakan
accept all | terima semua | ok, faham | setuju | [setuju] | got it | i agree | tolak semua | reject all | manage preferences | tetapan kuki
☰ | menu utama | main menu | cetak | e-mel | print | pdf | muat turun pdf | laporkan kesalahan | report an error
"""
_WHOLE = """
menu | iklan | cetak | e-mel | kongsi | share | tweet | facebook | whatsapp | telegram | twitter | english | bahasa melayu | utama | laman utama | home | search | carian | galeri | video | audio | about | about us | contact us | login | log masuk
"""
# Fixed values end.


def _starts(words: str) -> tuple[re.Pattern[str], set[str]]:
    """What matches the listed openings, and the first two characters of each."""
    parts = sorted({p.strip() for line in words.strip().split("\n") for p in line.split(" | ") if p.strip()}, key=len, reverse=True)
    return re.compile("(?:" + "|".join(re.escape(p) + (r"(?!\w)" if p[-1].isalnum() else "") for p in parts) + ")"), {p[:2] for p in parts}


_OPENING, _OPENS = _starts(_OPENINGS)
_ALONE = {p.strip() for p in _WHOLE.strip().split("|")}
_ADDRESS = re.compile(r"^[^.!?]{3,60}, (?:aras|tingkat|level|lantai|blok|block|suite)\b[^.!?]*$|,\s*(?:jalan|jln\.?|lorong|poskod)\s[^.!?]{0,40}$|,[^.!?,]{0,40}\s(?:street|road)$", re.I)
_ASIDE = re.compile(r"(?:iklan|advertisement|ditaja|sponsored)\W*$", re.I)
_REFERENCE = re.compile(r"^(?:rujukan|referensi|references?|sumber|nota(?: tambahan| kaki)?|notes?|catatan|pembetulan|correction|maksudnya|bermaksud|maksud|meaning|soalan|jawapan|ringkasan|pertanyaan|jawaban|question|answer|summary|kesimpulan|s|j|q|a)\s?(?:jawapan|answer)?\s*[:：]", re.I)
_QUOTE_LINE = re.compile(r"^\s*>")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s+\S|\*\*[^*]+\*\*\s*$)")
_DATE = re.compile(r"\b\d{1,2}\s?[/.\-]\s?\d{1,2}\s?[/.\-]\s?\d{2,4}\b|\b\d{1,2}[:.]\d{2}\b")
_LABEL = re.compile(r"^(?:[^\W\d_]+\.?[\s/-])?[^\W\d_]+\.?\s?[:：]\s|^(?:[^\W\d_]+\.?[\s/-]){0,4}[^\W\d_]+\s?[:：]$")
_HASH = re.compile(r"(?:^|\s)#[^\W\d]")
_WORD = re.compile(r"\w+")
_TOPICS = re.compile(r"^(?:\s*#\w[\w-]*)+\s*$")


def plain(line: str) -> str:
    """A line without markup; links leave their text."""
    if "](" in line:
        line = _LINK.sub(r"\1", line)
    if "<" in line:
        line = _TAG.sub("", line)
    return line.lstrip(_BEFORE).rstrip(_AFTER)


def _unlinked(line: str) -> str:
    """A line without its links and markup."""
    return (_LINK.sub("", line) if "](" in line else line).lstrip(_BEFORE).rstrip(_AFTER)


def _is_menu(text: str) -> bool:
    return bool(_SEPARATED.search(text) and _MENU.match(text) or (_HERE.match(text) or _SEPARATED.search(text)) and _CRUMB.match(text))


def _ended(text: str) -> bool:
    """Whether a line ends like a sentence."""
    return not text[-1:].isalnum() and bool(_ENDED.search(text[-16:]))


def is_furniture(line: str) -> bool:
    """Whether a line alone tells that it is page furniture."""
    low = plain(line).lower()
    if not low:
        return False
    if "](" in line and _LINK.search(line) and len(_unlinked(line).strip(" ,|·•")) < 4:
        return True  # nothing but links
    if len(low) >= LONG:
        return False
    low = " ".join(low.split())
    opens = low[:2] in _OPENS or low[:1] in _OPENS
    return bool(opens and _OPENING.match(low) or low in _ALONE or _ASIDE.fullmatch(low) or _is_menu(low) or "#" in line and _TOPICS.match(line) or "," in low and _ADDRESS.search(low))


def _same(a: str, b: str) -> bool:
    return a == b or (len(a) > 12 and len(b) > 12 and (a.startswith(b) or b.startswith(a)) and abs(len(a) - len(b)) < 40)


def _key(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def _shaped(line: str, text: str, bare: str) -> bool:
    """Whether the shape of a line that is no sentence, item, heading or quotation is that of furniture."""
    if len(bare.strip(" ,|·•")) < 4:
        return True  # nothing but links
    if len(text) >= LONG:
        return False
    if _is_menu(text) or "#" in line and _TOPICS.match(line):
        return True
    colon = ":" in text or "：" in text
    if colon and _REFERENCE.match(text) or _QUOTE_LINE.match(line) or _ITEM.match(line) or _HEADING.match(line):
        return False
    if unicodedata.category((line.lstrip(" \t>*_-") or " ")[0]) in ("So", "Sc", "Sm"):
        return True  # an icon, a copyright mark, an arrow
    if _ended(text):
        return False
    if colon and _LABEL.match(text) or "#" in text and _HASH.search(text):
        return True
    digits = sum(map(str.isdigit, text))
    if not digits:
        return not _LETTER.search(text)
    if _DATE.search(text):
        return True
    words = text.split()
    if len(words) <= 6 and any(w.strip(".,()").isdigit() for w in words):
        return True  # a counter
    return digits >= 0.3 * sum(map(str.isalnum, text))


def window_sums(size: Sequence[int]) -> list[int]:
    """For each line the text length of the window around it."""
    upto, n = [0, *accumulate(size)], len(size)
    return [upto[min(i + BLOCK // 2 + 1, n)] - upto[max(i - BLOCK // 2, 0)] for i in range(n)]


def text_block(size: Sequence[int], closed: Sequence[bool]) -> tuple[int, int] | None:
    """(first, last) line of text between the first surge and the last dive of the window sums; None without text.

    The page's level is the window sum that its median character stands in. ``closed``: lines that end like a sentence.
    """
    sums = window_sums(size)
    order = sorted(range(len(size)), key=sums.__getitem__)
    half = sum(size) / 2
    level = next(sums[i] for i, upto in zip(order, accumulate(size[i] for i in order), strict=True) if upto >= half)
    surge = max(LEAST_SURGE, LEVEL_SHARE * level)
    high = [s >= surge for s in sums]
    block = list(accumulate(not h for h in high))  # the same for lines with no low one between them
    for least in (PARAGRAPH, SHORT_PARAGRAPH):
        dense = [i for i, h in enumerate(high) if h and size[i] >= least and closed[i]]
        if dense:
            mass: Counter[int] = Counter()
            for i in dense:
                mass[block[i]] += size[i]
            most = max(mass.values())
            kept = [i for i in dense if mass[block[i]] >= MASS * most]
            return kept[0], kept[-1]
    return None


class _Each(dict):
    """What holds for a line, worked out when it is asked for, and once."""

    def __init__(self, of: Callable[[int], object]) -> None:
        self.of = of

    def __missing__(self, k: int) -> object:
        value = self[k] = self.of(k)
        return value


def _article(lines: list[str], title: str | None, listed: Callable[[str], bool]) -> tuple[list[int], list[bool]]:
    """The lines with a letter or digit, and for each whether it belongs to the article."""
    rows = [i for i, x in enumerate(lines) if _LETTER.search(x)]
    n = len(rows)
    out = [False] * n
    if not rows:
        return rows, out
    held = [lines[i] for i in rows]
    bare = [_unlinked(x) for x in held]
    texts = [plain(x) if "](" in x or "<" in x else b for x, b in zip(held, bare, strict=True)]
    size = [len(x) for x in bare]
    # most lines far from the article's ends are never asked about
    closed, keys = _Each(lambda k: _ended(texts[k])), _Each(lambda k: _key(texts[k]))
    block = text_block(size, closed)
    first, last = block or (n, -1)
    name = _key(title or "")
    head = next((i for i in range(min(n, first + 1)) if _same(keys[i], name)), None) if name else None
    if block is None:
        if head is not None:
            out[head] = True
        return rows, out
    shaped, known = _Each(lambda k: _shaped(held[k], texts[k], bare[k])), _Each(lambda k: listed(held[k]))
    again = Counter(keys[k] for k in range(first, last + 1) if size[k] < PARAGRAPH and not closed[k])
    odd = _Each(lambda k: shaped[k] or known[k] or (not closed[k] and again[keys[k]] > 1 and not (_HEADING.match(held[k]) or _ITEM.match(held[k]))))
    # a line that reads on: a sentence, a labelled note, a quotation, an item
    on = _Each(lambda k: not odd[k] and bool((size[k] >= PARAGRAPH and closed[k]) or _REFERENCE.match(texts[k]) or _QUOTE_LINE.match(held[k]) or (size[k] and _ITEM.match(held[k]))))
    # the dive's window: back over furniture, then on over lines that read on
    while last > first and odd[last]:
        last -= 1
    at = last + 1
    while at < n:
        k = at
        while k < min(n, at + GAP) and not on[k] and (known[k] or not shaped[k]):
            k += 1
        if k == n or not on[k]:
            break
        last, at = k, k + 1
    # the surge's window: the headline says what the title says, else it is a heading or a bare line above the text
    start = head
    if start is None:
        above = [i for i in range(first) if not odd[i]]
        headings = [i for i in above if _HEADING.match(held[i])]
        start = headings[0] if headings else above[-1] if above and size[above[-1]] > 15 else first
    for i in range(start, last + 1):
        out[i] = not odd[i]
    if head is not None:
        out[head] = True
    return rows, out


def article_lines(content: str, title: str | None = None, listed: Callable[[str], bool] = is_furniture) -> np.ndarray:
    """For each line (separated by line feeds) whether it belongs to the article; blank lines don't.

    ``listed`` tells of a line alone that it is furniture; it isn't asked about lines that something else decides.
    """
    lines = content.split("\n")
    out = np.zeros(len(lines), bool)
    rows, inside = _article(lines, title, listed)
    out[rows] = inside
    return out


def furniture_lines(df: DataFrame, keys: tuple[str, ...] = ("document_id", "crawl_batch_id"), title: str = "title", content: str = "content", unless: Callable[[list[str | None], list[str]], list[bool]] | None = None) -> DataFrame:
    """``keys`` and line_no (from 0, blank lines included) of every line with a letter or digit outside the article.

    Null and empty contents have no lines. A repeated row gives its lines again. ``unless`` tells of titles and
    contents which rows are to be left out.
    """
    kept = [f"k{i}" for i in range(len(keys))]
    rows = spread(df.where(F.col(content).isNotNull()).select(*[F.col(k).alias(a) for k, a in zip(keys, kept, strict=True)], F.col(title).alias("t"), F.col(content).alias("c")))
    schema = rows.select(*kept, F.lit(0).cast("long").alias("line_no")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, number = [], []
            titles, contents = b.column("t").to_pylist(), b.column("c").to_pylist()
            left_out = unless(titles, contents) if unless else [False] * len(titles)
            for r, (t, c) in enumerate(zip(titles, contents, strict=True)):
                if left_out[r]:
                    continue
                outside = [k for k, inside in zip(*_article(c.split("\n"), t, is_furniture), strict=True) if not inside]
                row += [r] * len(outside)
                number += outside
            yield pa.RecordBatch.from_arrays([*b.select(kept).take(pa.array(row, pa.int64())).columns, pa.array(number, pa.int64())], names=[*kept, "line_no"])

    return rows.mapInArrow(run, schema).select(*[F.col(a).alias(k) for k, a in zip(keys, kept, strict=True)], "line_no")


def bodies(df: DataFrame, keys: tuple[str, ...], content: str, title: str | None = None) -> DataFrame:
    """``keys`` and body: the lines of the article in order, joined by line feeds; null where the content is null."""
    kept = [f"k{i}" for i in range(len(keys))]
    rows = spread(df.select(*[F.col(k).alias(a) for k, a in zip(keys, kept, strict=True)], (F.col(title) if title else F.lit(None).cast("string")).alias("t"), F.col(content).alias("c")))
    schema = rows.select(*kept, F.lit(None).cast("string").alias("body")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t, c in zip(b.column("t").to_pylist(), b.column("c").to_pylist(), strict=True):
                found.append(None if c is None else "\n".join(x for x, ok in zip(c.split("\n"), article_lines(c, t), strict=True) if ok))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, pa.string())], names=[*kept, "body"])

    return rows.mapInArrow(run, schema).select(*[F.col(a).alias(k) for k, a in zip(keys, kept, strict=True)], "body")
