"""Problem 9: sentences of texts in several languages and scripts, by a semi-Markov dynamic programme.

In a block (what stands between blank lines) every terminal mark, every list mark at the start of a line and,
in Thai, every space may end a sentence. A segmentation is scored span by span: how the span closes (mark,
abbreviation, quotation with or without an introduction), how the next one opens, whether quotations and brackets
are balanced inside it, and its length. The best sequence of whole spans is found by dynamic programming.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.partitions import spread

# Abbreviations, lower case, without the last full stop.
#: Never the last word: titles, and what comes before a number or a name.
_NEVER = set("""
dr prof ust hj hjh pn tn en cik tuan mr mrs ms st sdr sdri drs ir kh tgk ybhg yab yb dato datuk rev hon gen col sgt
no hlm hal jil bil cet ed vol pp p fig ch sec art para cf vs viz i.e e.g a.l s.a.w s.w.t r.a a.s k.w sh bhd jln kg tmn
""".split())
#: Last words if a sentence opens behind them.
_LAST = set("dll dsb dst dkk etc al inc ltd co jr sr p.m a.m m h s.h b.c a.d u.s u.k".split())
_DOMAINS = set("example com org net edu gov my id sg uk info html htm php www".split())
# Fixed values end.

_BLANK = re.compile(r"\s*\n[^\S\n]*\n\s*")
_TOKEN = re.compile(
    r"[.!?؟۔。！？…]+"
    r"|\n[^\S\n]*(?=(?:[-*•–+]|\(?(?:[0-9٠-٩۰-۹๐-๙]{1,3}|[A-Za-z]|[ivx]{2,4})[.)]|（?[0-9一二三四五六七八九十]{1,3}[）、.])\s)"
    r"|(?<=[ก-๎)])\s+(?=[ก-๎])|(?<=[ก-๎])\s+(?=[A-Z])"
)
_MARK = re.compile(r"(?:^|\n)[^\S\n]*[(（]?(?:[0-9٠-٩۰-۹๐-๙]{1,3}|[A-Za-z]|[ivx]{2,4})$")
_SIGN = re.compile(r"[\"“”„«»「」『』()\[\]（）【】［］]")
_INITIAL = re.compile(r"[A-Za-z]\.\s")
_DOTS = set(".…")
_CLOSERS = "\"”“»」』)]）】］'’*_"
_QUOTES = "\"“”„«»「」『』"
_OPEN, _SHUT = "([（【［", ")]）】］"
#: What closing marks, and words that can't close or open a sentence, add to a span's score.
_TERMINAL, _AGAINST = 3.0, -8.0
#: A short word that may close a sentence: with a clear opening behind it the length of the spans decides.
_MAY_CLOSE = 1.0
#: A cut inside a balanced quotation or pair of brackets.
_UNBALANCED = -12.0
#: The most that the length of a span costs.
_LONGEST_COST = 0.8


def _length(n: int) -> float:
    """Cost of a span of n characters: lengths far from a usual sentence are less likely."""
    return min(_LONGEST_COST, 0.1 * (math.log(max(n, 1) / 90.0) / 0.9) ** 2)


def _first(text: str, at: int, end: int) -> str:
    """The first character from ``at`` that is no space, opening quote or bracket; empty at the end."""
    while at < end and (text[at].isspace() or text[at] in "\"“”„«»「『‘'([（【*_#-–•>"):
        at += 1
    return text[at] if at < end else ""


def _run(text: str, at: int, end: int) -> str:
    """The letters, digits and underscores from ``at``."""
    stop = at
    while stop < end and (text[stop].isalnum() or text[stop] == "_"):
        stop += 1
    return text[at:stop]


def _last_word(text: str, begin: int, at: int) -> str:
    """The letters and digits before ``at``, full stops between them included."""
    low = at
    while low > begin and (text[low - 1].isalnum() or (text[low - 1] == "." and low < at and low - 1 > begin and text[low - 2].isalnum())):
        low -= 1
    return text[low:at]


def _opening(after: str, cased: bool) -> float:
    """How well a span opens with the character ``after``."""
    return _AGAINST if (after.islower() and cased) or after in ",;:،؛，；：" else 0.0


def _closing(text: str, begin: int, at: int, stop: int, end: int) -> float:
    """How well a span closes with the marks ``text[at:stop]`` (closers left out of them) before ``end``."""
    marks = text[at:stop]
    after = _first(text, stop, end)
    if not after:
        return _TERMINAL
    dots = not (set(marks) - _DOTS)
    if dots and (len(marks) > 1 or marks == "…"):
        return _AGAINST  # an ellipsis
    spaced = text[stop].isspace()
    if marks != ".":
        return _TERMINAL if spaced or not dots else _TERMINAL - 1.0
    if not spaced:
        before = text[at - 1] if at > begin else ""
        if not (before.isalpha() or before in _CLOSERS or before.isdigit()) or not after.isalpha() or after.islower():
            return _AGAINST  # a decimal, a version, an address
        low = stop
        while low < end and text[low] in _CLOSERS:
            low += 1
        if _run(text, low, end).lower() in _DOMAINS:
            return _AGAINST
    said = _last_word(text, begin, at)
    if not said:
        return _TERMINAL if spaced else _AGAINST
    word = said.lower()
    parts = word.split(".")
    if len(parts) > 1 and word not in _NEVER and word not in _LAST and max(map(len, parts)) > 2:
        word, parts = parts[-1], parts[-1:]  # no space stands before the sentence that the abbreviation opens
    if word in _NEVER:
        return _AGAINST
    if word in _LAST:
        low = stop
        while low < end and text[low].isspace():
            low += 1
        follows = _run(text, low, end)
        titled = follows[:1].isupper() and (word not in ("p.m", "a.m") or not follows.isupper() or len(follows) == 1)
        return _MAY_CLOSE if titled or (not after.islower() and not after.isupper()) else _AGAINST
    if len(word) == 1 and word.isalpha() and not text[at - 1].islower():
        return _AGAINST  # an initial, an abbreviated title or a list mark
    if len(parts) > 1 and all(len(x) == 1 for x in parts):
        return _AGAINST
    if _MARK.search(text, max(begin - 1, 0, at - 8), at) and (at - len(word) <= begin or "\n" in text[max(begin, at - len(word) - 4) : at]):
        return _AGAINST
    return _TERMINAL if spaced else _TERMINAL - 1.0


def _pairs(text: str, begin: int, end: int) -> list[tuple[int, int, bool]]:
    """(opening, closing, whether a quotation) of the outermost balanced quotations and brackets of a block, in order.

    A mark without a partner in the block opens nothing, so it holds no sentence together.
    """
    out: list[tuple[int, int, bool]] = []
    quote, stack = -1, []
    for m in _SIGN.finditer(text, begin, end):
        c, at = m[0], m.start()
        if c in _QUOTES:
            if quote < 0:
                quote = at
            else:
                out.append((quote, at, True))
                quote = -1
        elif c in _OPEN:
            stack.append(at)
        elif stack:
            out.append((stack.pop(), at, False))
    out.sort()
    kept: list[tuple[int, int, bool]] = []
    for p in out:
        if not kept or p[1] > kept[-1][1]:
            kept.append(p)
    return kept


def _candidates(text: str, begin: int, end: int) -> list[tuple[int, float]]:
    """(place after it, score of a cut there) of every mark in a block that might end a sentence.

    The score adds up how the words before it close, how those behind it open, and what a cut inside a
    balanced quotation or pair of brackets costs.
    """
    cased = any(c.isupper() for c in text[begin:end])
    pairs = _pairs(text, begin, end)
    k, out, stop = 0, [], begin
    for m in _TOKEN.finditer(text, begin, end):
        at = m.start()
        if at < stop:
            continue  # a closer that went with its mark
        c = m[0][0]
        if c.isspace():
            # a Thai space, or a list mark that opens an item; a letter and a full stop may be initials, broken over lines
            while k < len(pairs) and pairs[k][1] < at:
                k += 1
            held = k < len(pairs) and pairs[k][0] < at
            score = _TERMINAL - 1.0 if c != "\n" or not _INITIAL.match(text, m.end()) or _ends(text, begin, at, end, cased) else _AGAINST
            out.append((at, score + held * _UNBALANCED))
            continue
        stop = marks_end = m.end()
        while k < len(pairs) and pairs[k][1] < at:
            k += 1
        inside = k < len(pairs) and pairs[k][0] < at
        while stop < end and text[stop] in _CLOSERS:
            x = text[stop]
            if x in _QUOTES and not (inside and pairs[k][2] and pairs[k][1] >= stop):
                break  # it opens the next one
            if x in _SHUT and not (inside and pairs[k][1] >= stop):
                break
            stop += 1
        if stop >= end:
            continue
        after = _first(text, stop, end)
        score = _opening(after, cased) if after else 0.0
        if inside and pairs[k][1] < stop:  # the pair ends with this mark
            if pairs[k][2]:
                low = pairs[k][0] - 1
                while low >= begin and text[low].isspace():
                    low -= 1
                # behind an introduction the quotation closes the sentence; else the words that follow belong to it
                score += _TERMINAL if low >= begin and text[low] in ":：" else _AGAINST
            else:
                score += _AGAINST  # marks in brackets end nothing
        else:
            score += _closing(text, begin, at, marks_end, end) + inside * _UNBALANCED
        out.append((stop, score))
    return out


def _ends(text: str, begin: int, at: int, end: int, cased: bool) -> bool:
    """Whether a sentence may end right before the whitespace at ``at``."""
    k = at - 1
    while k > begin and (text[k].isspace() or text[k] in _CLOSERS):
        k -= 1
    if text[k] not in ".!?؟۔。！？":
        return False
    after = _first(text, k + 1, end)
    return _closing(text, begin, k, k + 1, end) + (_opening(after, cased) if after else 0.0) > 0


def _best(begin: int, end: int, found: list[tuple[int, float]]) -> list[int]:
    """Ends of the spans of the best segmentation, without that of the block.

    A span's score is that of the cut it ends with less the cost of its length. A start is dropped when another
    one leads by more than a length can cost: no later span could make that good, so nothing is lost, and there is
    no longest span.
    """
    best, back, at = [0.0], [0], [begin]
    live = [0]
    for place, score in [*found, (end, 0.0)]:
        v, i = max((best[i] - _length(place - at[i]), i) for i in live)
        best.append(v + score), back.append(i), at.append(place)
        lead = max(best[i] for i in live)
        lead = max(lead, best[-1])
        live = [i for i in [*live, len(at) - 1] if best[i] >= lead - _LONGEST_COST]
    out, j = [], back[-1]
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences in order, in code points, without the whitespace around them.

    Every character other than whitespace is in one of them; null and blank texts have none.
    """
    if not text:
        return []
    out, n = [], len(text)
    begin = n - len(text.lstrip())
    blanks = [(m.start(), m.end()) for m in _BLANK.finditer(text, begin)]
    for stop, after in [*blanks, (n, n)]:
        if stop > begin:
            low = begin
            for p in [*_best(begin, stop, _candidates(text, begin, stop)), stop]:
                s, e = low, p
                while s < e and text[s].isspace():
                    s += 1
                while e > s and text[e - 1].isspace():
                    e -= 1
                if e > s:
                    out.append((s, e))
                low = p
        begin = after
    return out


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """``key``, sentence_no (from 0), start_pos, end_pos and, if wanted, sentence of every text.

    Null, empty and blank texts have no rows. Each row of the input is taken by itself; other columns are dropped.
    """
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()))
    names = ["k", "sentence_no", "start_pos", "end_pos", *["sentence"] * with_text]
    zero = F.lit(0).cast("long")
    schema = rows.select("k", zero.alias("sentence_no"), zero.alias("start_pos"), zero.alias("end_pos"), *[F.lit("").alias("sentence")] * with_text).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, number, start, end, said = [], [], [], [], []
            for r, t in enumerate(b.column("t").to_pylist()):
                spans = sentence_spans(t)
                row += [r] * len(spans)
                number += range(len(spans))
                start += [s for s, _ in spans]
                end += [e for _, e in spans]
                if with_text:
                    said += [t[s:e] for s, e in spans]
            columns = [b.column("k").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (number, start, end))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(said, pa.string())][: len(names)], names=names)

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)
