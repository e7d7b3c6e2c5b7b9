"""Problem 5: template residue, filler and notices in the place of articles.

Character n-gram models of filler, placeholders, default titles, notices and natural prose (all lines of the table)
give a log-likelihood ratio for every n-gram; residue is where windows have a high mean ratio. Placeholders are told by the shape of
their marks, the words between them left out. Filler and placeholders exclude a row wherever they stand; a notice or
a default title excludes it by coverage, if it stands instead of an article or is the whole title.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.partitions import spread
from loomspan.llm.pages import is_furniture

N, TABLE_BITS, WINDOW = 4, 18, 28
#: The place of a run that would go from one line into the next.
NOWHERE = 1 << TABLE_BITS
#: Ratios are between -CLIP and CLIP; bounds of their sums are counted in units of which FINE are one.
CLIP, FINE = 4, 1024
#: Sums of so many bounds don't fit into half of 64 bits.
TOO_LONG = 1 << 17
#: Placeholders: the n-grams of their shapes, and how many of them in a row have a high mean ratio.
MARK_N, MARK_WINDOW, MARK_RATIO = 3, 3, 2.5
BACKGROUND = 0.2
#: Texts are joined to about so many characters before their n-grams are counted.
AT_ONCE = 1 << 18
#: Rows of about so many characters are classified together.
TOGETHER = 1 << 16
#: Mean log-likelihood ratios from which a window is filler, a line a notice, and a title or words in brackets unfilled.
FILLER_RATIO, NOTICE_RATIO, TITLE_RATIO = 1.2, 1.0, 2.2
#: Share of a default title's n-grams that a title must hold.
TITLE_COVERAGE = 0.7
#: Share of notice among notice and article text from which a row is excluded.
COVERAGE = 0.5

# Texts that the models of filler and notices are fitted on.
FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor
in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident
teks contoh ayat pertama untuk susun atur teks contoh perenggan kedua untuk reka letak teks contoh tajuk ketiga untuk pereka
teks contoh bahagian pertama untuk ujian paparan teks contoh ayat kedua untuk pereka teks contoh bahagian ketiga untuk susun atur
isi artikel akan diletakkan di sini sila masukkan kandungan di sini masukkan teks di sini tulis isi artikel di sini
your text goes here insert content here insert text here sample paragraph for layout sample text for layout placeholder text
contoh teks untuk tata letak masukkan konten di sini isi artikel akan ditempatkan di sini teks pengganti
masukkan tajuk masukkan nama isi tajuk di sini insert title enter title your title here page title untitled document untitled page default title
""".strip().split("\n")
NOTICES = """
404 not found
page not found
the requested url was not found on this server
the page you are looking for does not exist
halaman tidak dijumpai
halaman tidak ditemukan
maaf, halaman yang anda cari tiada
ralat 404
ralat dalaman pelayan
403 forbidden
access denied
akses ditolak
you don't have permission to access this resource
you are not authorized to view this page
anda tidak dibenarkan melihat laman ini
500 internal server error
502 bad gateway
503 service temporarily unavailable
504 gateway timeout
service unavailable
something went wrong on our side
an unexpected error occurred
error establishing a database connection
gagal menyambung ke pangkalan data
too many requests, slow down
down for maintenance
site under maintenance
laman dalam penyelenggaraan
sistem ditutup sementara
kami akan kembali sebentar lagi
we will be back soon
your session has expired
sesi anda telah tamat
please log in again
javascript is disabled
you need to enable javascript to run this app
please enable javascript in your browser
this page requires scripts to be turned on
sila hidupkan javascript dalam pelayar anda
checking your browser before access
verifying you are human
sahkan anda bukan robot
please complete the captcha
this account has been suspended
your browser is not supported
cookies must be enabled
please enable cookies and reload the page
bandwidth limit exceeded
http error 410 gone
the page has been removed or moved
sorry, this page isn't available
this content is no longer available
the site is temporarily offline
akaun ini telah digantung
pelayar anda tidak disokong
akun ini ditangguhkan
peramban anda tidak didukung
situs sedang dalam perbaikan
seite nicht gefunden
zugriff verweigert
page introuvable
acceso denegado
pagina no encontrada
الصفحة غير موجودة
لم يتم العثور على الصفحة
تم رفض الوصول
الموقع تحت الصيانة
صفحہ نہیں ملا
رسائی سے انکار
页面不存在
找不到页面
您访问的页面不存在
拒绝访问
网站维护中
请启用JavaScript
ไม่พบหน้าที่คุณต้องการ
ไม่มีสิทธิ์เข้าถึง
ปิดปรับปรุงระบบ
""".strip().split("\n")
PLACEHOLDERS = """
{{ nama }} | {{tajuk}} | {{ page.title }} | {{{ isi }}} | {{{isi}}} | {% block isi %} | {%if x%} | {% end %} | {{nama penulis}} | {{ nama penulis }} | <%= tarikh %> | <%= post.id %> | <% isi %> | <%=isi%> | <%isi%>
${nama} | ${page.title} | ${ nama } | {$nama} | {$bil_paparan} | #{title} | #{page.title} | {first_name} | <<first_name>> | << nama >> | *|FNAME|* | *|nama|* | [% title %] | [%title%]
[[nama]] | [[ tajuk ]] | [[nama_penulis]] | %nama% | %nama_penulis% | %%nama%% | %NAMA% | @@nama@@ | @@page.title@@ | ##nama## | ##PAGE.TITLE## | @@NAMA@@ | __NAMA__ | __NAMA_PENULIS__ | $$nama$$ | ~~NAMA~~
"""
#: What may stand beside a placeholder.
BESIDE = [("", ""), (" ", " "), (" ", "."), (" ", ","), ("(", ")"), ('"', '"'), (": ", ""), ("\n", "\n"), (" ", ":"), (" ", "!"), (" ", "?"), (" ", ";"), ("/", "/"), (">", "<"), ("**", "**")]
UNFILLED = """
masukkan tajuk | masukkan tajuk di sini | isi nama di sini | tulis nama penulis | sila masukkan tarikh | masukkan teks | isi tajuk artikel | tulis isi di sini | masukkan nama penulis | sila isi
insert title here | enter title | your name here | add text here | enter date | type here | your text here | add a description | insert image | enter your name | insert link
""".replace("\n", "|").split("|")
DEFAULT_TITLES = """
untitled | untitled document | untitled page | new page | page title | title here | your title here | insert title here | enter title here | default title | hello world! | sample page | home page title
tajuk di sini | tajuk halaman | tanpa tajuk | tiada tajuk | masukkan tajuk | judul di sini | tanpa judul | undefined | null | none | nan | [object object] | todo | tbd
""".replace("\n", "|").split("|")
# Fixed values end.

#: Words, with what joins them to a name, and numbers: one symbol each in a shape.
_NAME = re.compile(r"[^\W_]+(?:[_.][^\W_]+)*")
_MARKS = re.compile(r"[{}<>$%@#|\[\]*~_](?:(?<!_)|_)")  # one of them, or two low lines
_BRACKETS = re.compile(r"\[([^\[\]\n]{3,60})\](?!\()")
_PATH = re.compile(r"(?<!\S)\S*/\S*")
_SPACES = re.compile(r"[^\S\n]+")
_DIGIT = re.compile(r"[0-9]+")
#: What characters are, one bit each; `_KINDS` is filled as they are met.
_IN_NAME, _NUMBER, _UPPER, _LOWER, _JOINS, _SPACE, _MET = (1 << k for k in range(7))
_KINDS = np.zeros(0x110000, np.uint8)
_SITE = re.compile(r"\s+[-|–—]\s+")
_CLOSED = re.compile(r"[.!?؟。！？…][\"'”’»)\]*_\s]*$")
#: A line of an article: long, and closed like a sentence.
ARTICLE_LINE = 60


#: Characters around a line that count as markup.
_EDGES = " \t\r#*_>"


def _hashed(codes: np.ndarray, size: int = N) -> np.ndarray:
    """Table places of the runs of ``size`` code points."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = codes[:n].copy()
    for k in range(1, size):
        h *= np.uint32(0x01000193)
        h += codes[k : n + k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


def _grams(text: str) -> np.ndarray:
    """Table places of the character n-grams of a text (of which digits are one symbol)."""
    return _hashed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def _symbol(m: re.Match[str]) -> str:
    word = m[0]
    return "0" if word[0].isdigit() else "A" if word.isupper() and len(word) > 1 else "a"


def _shape_grams(text: str) -> np.ndarray:
    """Table places of the n-grams of a text's shape: each name is one symbol, each run of spaces one space."""
    shape = _SPACES.sub(" ", _NAME.sub(_symbol, text))
    return _hashed(np.frombuffer(shape.encode("utf-32-le", "surrogatepass"), np.uint32), MARK_N)


def _plain(line: str) -> str:
    return f" {_DIGIT.sub('0', line.lower()).strip(_EDGES)} "


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Of some lines: the table place of the run that begins at each code point (NOWHERE if it isn't inside a line), where
#: the lines begin, and how many runs each has.
Places = tuple[np.ndarray, np.ndarray, np.ndarray]


def _of_lines(codes: np.ndarray, size: int) -> Places:
    breaks = np.flatnonzero(codes == 10)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(codes)]])
    places = np.full(len(codes), NOWHERE)
    runs = _hashed(codes, size)
    places[: len(runs)] = runs
    for k in range(size):
        at = breaks - k
        places[at[at >= 0] if k else at] = NOWHERE
    return places, starts, np.maximum(ends - starts - (size - 1), 0)


def _line_grams(text: str) -> Places:
    """:func:`_grams` of each :func:`_plain` line of a text."""
    codes = _codes("\n".join([f" {x.strip(_EDGES)} " for x in text.lower().split("\n")]))
    digits = np.flatnonzero(codes - np.uint32(48) < 10)
    if len(digits):
        codes = codes.copy()
        codes[digits] = 48
        kept = np.ones(len(codes), bool)
        kept[digits[1:][np.diff(digits) == 1]] = False
        codes = codes[kept]
    return _of_lines(codes, N)


def _kinds(codes: np.ndarray) -> np.ndarray:
    kinds = _KINDS[codes]
    new = set(codes[kinds == 0].tolist())
    for c in new:
        x = chr(c)
        upper = x.isupper()
        lower = x.islower() or x.istitle() and not upper
        _KINDS[c] = _MET | _IN_NAME * x.isalnum() | _NUMBER * x.isdigit() | _UPPER * upper | _LOWER * lower | _JOINS * (x in "_.") | _SPACE * (x.isspace() and x != "\n")
    return _KINDS[codes] if new else kinds


def _line_shapes(text: str) -> tuple[Places, Places]:
    """:func:`_shape_grams` of the lines of a text, as they are and as they are in capitals."""
    return tuple(_of_lines(shape, MARK_N) for shape in _shapes(text))


def _shapes(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = _codes(" " + text.replace("\n", " \n ") + " ")
    kinds = _kinds(codes)
    letter = np.concatenate([[False], (kinds & _IN_NAME) > 0, [False]])
    name = letter[1:-1] | ((kinds & _JOINS) > 0) & letter[:-2] & letter[2:]
    space = (kinds & _SPACE) > 0
    begins = name & ~np.concatenate([[False], name[:-1]])
    kept = np.flatnonzero(begins | ~(name | space & np.concatenate([[False], space[:-1]])))
    shape, at = codes[kept], np.flatnonzero(begins[kept])
    shape[space[kept]] = 32
    capitals = shape.copy()
    if len(at):
        starts = kept[at]
        held, long = np.bitwise_or.reduceat(kinds * name, starts), name[starts + 1]  # a space stands behind the last name
        number = (kinds[starts] & _NUMBER) > 0
        cased = long & ((held & (_UPPER | _LOWER)) > 0)
        shape[at] = np.where(number, 48, np.where(cased & ((held & _LOWER) == 0), 65, 97))
        capitals[at] = np.where(number, 48, np.where(cased, 65, 97))
    return shape, capitals


#: The tables of fillers and of notices of one fit.
Round = tuple[list[np.ndarray], np.ndarray]


def _bounds(fillers: Sequence[np.ndarray], notice: np.ndarray) -> np.ndarray:
    """For each place upper bounds of its ratios, made positive by CLIP: of filler in the upper half of 64 bits, of notice
    in the lower. Their sums tell cheaply and surely where neither ratio is high."""
    filler, said = (np.ceil((t.astype(np.float64) + CLIP) * FINE).astype(np.int64) for t in (np.max(fillers, axis=0), notice))
    return np.append(filler << 32 | said, 0)


def _may_reach(sums: np.ndarray, sizes: np.ndarray, ratio: float) -> np.ndarray:
    """Whether the mean ratio of lines with these sums of bounds may be so high."""
    return (sizes > 0) & ((sums >= (ratio + CLIP) * FINE * sizes - 1) | (sizes >= TOO_LONG))


def _mean(table: np.ndarray, places: np.ndarray) -> float:
    return float(table[places].sum(dtype=np.float64) / len(places))


def count_grams(texts: Iterable[str | None], rounds: Sequence[Round] = ()) -> np.ndarray:
    """How often the lines of texts hold each n-gram; without ``rounds`` also each n-gram of shapes, by fours: four for
    a line as it is and one for the line in capitals. ``rounds`` leave out the lines that look like residue by them."""
    counts = np.zeros((2, NOWHERE + 1), np.int64)
    bounds = [_bounds(*r) for r in rounds]

    def add(text: str) -> None:
        places, starts, sizes = _line_grams(text)
        for (fillers, notice), bound in zip(rounds, bounds, strict=True):
            sums = np.add.reduceat(bound.take(places), starts)
            for k in np.flatnonzero(_may_reach(sums >> 32, sizes, FILLER_RATIO / 4) | _may_reach(sums & 0xFFFFFFFF, sizes, NOTICE_RATIO / 2)):
                line = places[starts[k] : starts[k] + sizes[k]]
                if max(_mean(t, line) for t in fillers) >= FILLER_RATIO / 4 or _mean(notice, line) >= NOTICE_RATIO / 2:
                    line[:], sizes[k] = NOWHERE, 0
        counts[0] += np.bincount(places, minlength=NOWHERE + 1)
        if not rounds:
            for weight, (places, _, _) in zip((4, 1), _line_shapes(text), strict=True):
                counts[1] += weight * np.bincount(places, minlength=NOWHERE + 1)

    held: list[str] = []
    length = 0
    for text in texts:
        if text:
            held.append(text)
            length += len(text)
        if length >= AT_ONCE:
            add("\n".join(held))
            held, length = [], 0
    if held:
        add("\n".join(held))
    return counts[:, :NOWHERE]


class Models:
    """Log-likelihood ratios of n-grams, filler to prose and notice to prose.

    ``prose``: texts, or what counts their n-grams as :func:`count_grams` does, given its ``rounds``.
    """

    def __init__(self, prose: Iterable[str] | Callable[[Sequence[Round]], np.ndarray]) -> None:
        counted = prose if callable(prose) else partial(count_grams, list(prose))
        draw = random.Random(1)
        latin = " ".join(FILLER[:3]).split()
        lorem = [_plain(x) for x in FILLER[:3]] + [_plain(" ".join(draw.choice(latin) for _ in range(12))) for _ in range(400)]  # words in any order
        told = [_plain(x) for x in FILLER[3:]]  # a model of its own: the large one would outweigh it
        notices = [_plain(x) for x in NOTICES]
        rounds: list[Round] = []
        held, shapes = counted(rounds)
        for _ in range(2):  # once more without the lines that look like residue themselves
            self.fillers = [self._ratio(lorem, held), self._ratio(told, held)]
            self.notice = self._ratio(notices, held)
            rounds.append((self.fillers, self.notice))
            held = counted(rounds)[0]
        self.titles = self._ratio([_plain(x) for x in DEFAULT_TITLES if x.strip()], held)
        self.title_grams = [set(_grams(_plain(x)).tolist()) for x in DEFAULT_TITLES if x.strip()]
        marks = [x.strip() for line in PLACEHOLDERS.strip().split("\n") for x in line.split(" | ")]
        self.marks = self._table([_shape_grams(f"{a}{x}{b}") for w in marks for x in {w, w.upper()} for a, b in BESIDE], shapes / 4)
        self.unfilled = self._ratio([_plain(x) for x in UNFILLED if x.strip()], held)

    def _ratio(self, residue: list[str], prose: np.ndarray) -> np.ndarray:
        return self._table([_grams(x) for x in residue], prose)

    @staticmethod
    def _table(residue: list[np.ndarray], prose: np.ndarray) -> np.ndarray:
        a, b = np.bincount(np.concatenate(residue), minlength=1 << TABLE_BITS), prose + 0.1
        b = b / b.sum()
        # the small model is smoothed by the large one: n-grams it has not seen speak for prose
        a = (1 - BACKGROUND) * a / a.sum() + BACKGROUND * b
        return np.clip(np.log(a) - np.log(b), -CLIP, CLIP).astype(np.float32)

    @cached_property
    def mark_ratios(self) -> np.ndarray:
        return np.append(self.marks.astype(np.float64), -np.inf)  # no window goes from one line into the next

    @cached_property
    def bounds(self) -> np.ndarray:
        return _bounds(self.fillers, self.notice)

    def windows(self, line: str) -> float:
        """The highest mean ratio of filler in the windows of a line."""
        g = _grams(_plain(line))
        if len(g) < 8:
            return -4.0
        w = min(WINDOW, len(g))
        sums = [np.concatenate([[0], np.cumsum(f[g], dtype=np.float64)]) for f in self.fillers]
        return max(float((s[w:] - s[:-w]).max() / w) for s in sums)

    @staticmethod
    def mean(table: np.ndarray, text: str) -> float:
        """The mean ratio of a whole text."""
        g = _grams(_plain(text))
        return float(table[g].mean()) if len(g) else -4.0

    def reaching(self, table: np.ndarray, texts: list[str], ratio: float) -> list[int]:
        """Which of some texts have a mean ratio so high: all are summed at once, those near it are looked at."""
        if not texts:
            return []
        places, starts, sizes = _line_grams("\n".join(["" if "\n" in x else x for x in texts]))
        near = np.add.reduceat(np.append(table, np.float32(0)).take(places), starts, dtype=np.float64) >= (ratio - 0.01) * np.maximum(sizes, 1)
        return [k for k, x in enumerate(texts) if (near[k] or "\n" in x) and self.mean(table, x) >= ratio]


def _marked(text: str) -> list[str]:
    """The lines of a text that hold marks."""
    lines, at = [], 0
    while at >= 0 and (mark := _MARKS.search(text, at)):
        begins, at = text.rfind("\n", 0, mark.start()) + 1, text.find("\n", mark.start())
        lines.append(text[begins:at] if at >= 0 else text[begins:])
    return lines


def placeholders(texts: Sequence[str], models: Models) -> set[int]:
    """Which texts hold marks whose shape, or words in a pair of brackets that, are those of an unfilled placeholder."""
    lines, row = [], []
    for r, text in enumerate(texts):
        found = _marked(text)
        lines += found
        row += [r] * len(found)
    if not lines:
        return set()
    places, starts, _ = _of_lines(_shapes("\n".join(lines))[0], MARK_N)
    ratios = models.mark_ratios.take(places)
    n = max(len(ratios) - MARK_WINDOW + 1, 0)
    high = np.flatnonzero(sum(ratios[k : n + k] for k in range(MARK_WINDOW)) >= MARK_RATIO * MARK_WINDOW)
    out = {row[k] for k in (np.searchsorted(starts, high, "right") - 1).tolist()}
    said = [(r, x) for r, line in zip(row, lines, strict=True) if "[" in line and r not in out for x in _BRACKETS.findall(line)]
    return out | {said[k][0] for k in models.reaching(models.unfilled, [x for _, x in said], TITLE_RATIO)}


def default_titles(titles: Sequence[str], models: Models) -> list[int]:
    """Which titles, without the name of a site behind them, are as a whole what a template has before it is filled:
    their ratio is high, and they cover most of one default title, not just a word of it."""
    names = [_SITE.split(t.strip(), maxsplit=1)[0] for t in titles]
    out = []
    for k in models.reaching(models.titles, names, TITLE_RATIO):
        held = set(_grams(_plain(names[k])).tolist())
        if any(len(held & t) >= TITLE_COVERAGE * len(t) for t in models.title_grams):
            out.append(k)
    return out


def _filler_lines(bounds: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Which lines may have a window of filler, or be filler if they are shorter than a window and have ``least`` runs."""
    upto = np.concatenate([[0], np.cumsum(bounds)])
    short = (sizes >= least) & (sizes < WINDOW)
    out = short & _may_reach((upto[starts + sizes] - upto[starts]) >> 32, sizes, FILLER_RATIO)
    high = np.flatnonzero((upto[WINDOW:] - upto[:-WINDOW]) >= int((FILLER_RATIO + CLIP) * FINE * WINDOW - 1) << 32)
    out[np.searchsorted(starts, high, "right") - 1] = True
    return out


def _is_filler(places: np.ndarray, sizes: np.ndarray, models: Models) -> bool:
    flat, ends = places[places != NOWHERE], np.cumsum(sizes)
    line_of = np.repeat(np.arange(len(sizes)), sizes)
    short = (sizes >= 12) & (sizes < WINDOW)
    for filler in models.fillers:
        s = np.concatenate([[0], np.cumsum(filler[flat], dtype=np.float64)])
        if len(flat) >= WINDOW:
            mean = (s[WINDOW:] - s[:-WINDOW]) / WINDOW
            if ((mean >= FILLER_RATIO) & (line_of[: len(mean)] == line_of[WINDOW - 1 :])).any():
                return True
        if (short & ((s[ends] - s[ends - sizes]) >= FILLER_RATIO * np.maximum(sizes, 1))).any():
            return True
    return False


def _classify(titles: list[str], contents: list[str], models: Models) -> list[str | None]:
    kinds: list[str | None] = [None] * len(titles)
    for k in {*placeholders(titles, models), *default_titles(titles, models), *placeholders(contents, models)}:
        kinds[k] = "placeholder"
    places, starts, sizes = _line_grams("\n".join(["" if "\n" in x else x for x in titles]))
    may = _filler_lines(models.bounds.take(places), starts, sizes, 8)
    for k, title in enumerate(titles):
        if (may[k] or "\n" in title) and kinds[k] is None and models.windows(title) >= FILLER_RATIO:
            kinds[k] = "filler"
    places, starts, sizes = _line_grams("\n".join(contents))
    bounds = models.bounds.take(places)
    n_lines = np.array([x.count("\n") + 1 for x in contents])
    upto = np.cumsum(n_lines)  # lines up to the end of each row
    first = upto - n_lines
    ends = np.append(starts[1:], len(places))
    for k in set(np.searchsorted(upto, np.flatnonzero(_filler_lines(bounds, starts, sizes, 12)), "right").tolist()):
        if kinds[k] is None and _is_filler(places[starts[first[k]] : ends[upto[k] - 1]], sizes[first[k] : upto[k]], models):
            kinds[k] = "filler"
    notice = (sizes >= 3) & _may_reach(np.add.reduceat(bounds, starts) & 0xFFFFFFFF, sizes, NOTICE_RATIO)
    for k in np.flatnonzero(notice):
        notice[k] = _mean(models.notice, places[starts[k] : starts[k] + sizes[k]]) >= NOTICE_RATIO
    asked = [(first[k] + i, x) for k, c in enumerate(contents) if "/" in c and kinds[k] is None for i, x in enumerate(c.split("\n")) if "/" in x]
    asked = [(i, _PATH.sub("", x)) for i, x in asked if sizes[i] >= 3 and not notice[i]]  # the address that was asked for may stand in the words of the notice
    for k in models.reaching(models.notice, [x for _, x in asked], NOTICE_RATIO):
        notice[asked[k][0]] = True
    for k in set(np.searchsorted(upto, np.flatnonzero(notice), "right").tolist()):
        if kinds[k] is None:
            article = said = 0
            for x, is_notice in zip(contents[k].split("\n"), notice[first[k] : upto[k]].tolist(), strict=True):
                if is_notice:
                    said += len(x)
                elif len(x) >= ARTICLE_LINE and _CLOSED.search(x[-16:]) and not is_furniture(x):
                    article += len(x)
            if said >= COVERAGE * (said + article):
                kinds[k] = "notice"
    return kinds


def classify_all(titles: Sequence[str | None], contents: Sequence[str | None], models: Models) -> list[str | None]:
    """``placeholder``, ``filler``, ``notice`` or None for each row; a null is as an empty text."""
    out: list[str | None] = []
    held: list[tuple[str, str]] = []
    length = 0
    for t, c in zip(titles, contents, strict=True):
        held.append((t or "", c or ""))
        length += len(held[-1][0]) + len(held[-1][1])
        if length >= TOGETHER:
            out += _classify(*map(list, zip(*held, strict=True)), models)
            held, length = [], 0
    return out + (_classify(*map(list, zip(*held, strict=True)), models) if held else [])


def classify(title: str | None, content: str | None, models: Models) -> str | None:
    """The same for one row."""
    return classify_all([title], [content], models)[0]


def fit(df: DataFrame, content: str = "content") -> Models:
    """Models fitted on all lines of all rows, whatever their length: n-grams are counted in three passes over the
    contents, and sums by n-gram come to the driver."""
    texts = spread(df.select(F.col(content).alias("c")).where("c IS NOT NULL"))

    def counted(rounds: Sequence[Round]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = count_grams((t for b in batches for t in b.column("c").to_pylist()), rounds).ravel()
            places = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(counts[places])], names=["place", "n"])

        sums = texts.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(2 << TABLE_BITS, np.int64)
        counts[sums.column("place").to_numpy()] = sums.column("n").to_numpy()
        return counts.reshape(2, -1)

    return Models(counted)


def residue(df: DataFrame, models: Models | None = None, keys: tuple[str, ...] = ("document_id", "crawl_batch_id"), title: str = "title", content: str = "content") -> DataFrame:
    """``keys`` and kind (placeholder, filler, notice) of the rows to exclude; a repeated row counts once.

    Null and empty titles and contents are no residue. Whole texts are read, whatever their length.
    """
    models = models or fit(df, content)
    kept = [f"k{i}" for i in range(len(keys))]
    rows = spread(df.select(*[F.col(k).alias(a) for k, a in zip(keys, kept, strict=True)], F.col(title).alias("t"), F.col(content).alias("c")))
    schema = rows.select(*kept, F.lit(None).cast("string").alias("kind")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(classify_all(b.column("t").to_pylist(), b.column("c").to_pylist(), models), pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), found], names=[*kept, "kind"]).filter(found.is_valid())

    return rows.mapInArrow(run, schema).select(*[F.col(a).alias(k) for k, a in zip(keys, kept, strict=True)], "kind").distinct()
