"""Problem 7: evaluation texts leaking into training text, by a distributed positional inverted index.

The index is split by documents. Each row is a segment: a bounded run of documents with the postings of
all their tokens (sorted term ids, where each term's postings begin, token positions) and the documents'
token ranges. Segments can be written as a table and searched again for other test items.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.partitions import spread
from loomspan.llm.words import WordIds, words

MIN_WORDS, SLOP = 12, 6
#: Tokens after which a segment ends. A document is never cut: one that is longer has a segment of its own.
SEGMENT_TOKENS = 250_000
#: Test items up to this many bytes of text go to every task as one closure.
MAX_ITEM_BYTES = 64 << 20
_ARRAYS = ("doc_ids", "doc_starts", "terms", "term_starts", "positions")


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Segments of a positional index over all tokens. Null and empty texts have no postings.

    Every row is taken as a document; rows that repeat an id give its matches once more, which
    :func:`search_index` makes one. Rows with a null id are left out.
    """
    picked = spread(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("t")))
    kind = picked.schema["id"].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size, word_ids, id_type = [], [], 0, WordIds(), None

        def segment() -> pa.RecordBatch:
            tokens = np.concatenate(parts).view(np.int64)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            order = np.argsort(tokens, kind="stable").astype(np.int32)
            in_order = tokens[order]
            first = np.concatenate([[0], np.flatnonzero(in_order[1:] != in_order[:-1]) + 1])
            columns = [pa.array(ids, id_type), starts, in_order[first], np.append(first, len(order)).astype(np.int32), order]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns], names=list(_ARRAYS))

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), strict=True):
                found = word_ids.of(t)
                if not len(found):
                    continue
                if parts and size + len(found) > segment_tokens:
                    yield segment()
                    ids, parts, size = [], [], 0
                ids.append(i), parts.append(found)
                size += len(found)
        if parts:
            yield segment()

    return picked.mapInArrow(segments, f"doc_ids array<{kind}>, doc_starts array<int>, terms array<bigint>, term_starts array<int>, positions array<int>")


class _Segment:
    """Token postings of one segment. In ``places`` the lists stand behind one another, each moved by its term's number."""

    def __init__(self, doc_ids: pa.Array, doc_starts: np.ndarray, terms: np.ndarray, term_starts: np.ndarray, positions: np.ndarray) -> None:
        self.doc_ids, self.doc_starts, self.terms, self.term_starts, self.positions = doc_ids, doc_starts, terms, term_starts.astype(np.int64), positions
        self.n = len(positions)
        self.places = np.repeat(np.arange(len(terms), dtype=np.int64) * self.n, np.diff(self.term_starts)) + positions
        self.doc_of = np.repeat(np.arange(len(doc_starts) - 1, dtype=np.int32), np.diff(doc_starts))

    def local(self, terms: np.ndarray) -> np.ndarray:
        """Term numbers in this segment, -1 where a term doesn't occur."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def counts(self, terms: np.ndarray) -> np.ndarray:
        """Postings of each term, by its number here."""
        known = np.maximum(terms, 0)
        return np.where(terms >= 0, self.term_starts[known + 1] - self.term_starts[known], 0)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the terms, position) of all postings of some terms."""
        sizes = self.counts(terms)
        which = np.repeat(np.arange(len(terms)), sizes)
        first = self.term_starts[np.maximum(terms, 0)]
        return which, self.positions[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(len(which))].astype(np.int64)

    def hold(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether the terms' lists hold the positions."""
        wanted = terms.astype(np.int64) * self.n + positions
        at = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
        return (terms >= 0) & (positions >= 0) & (positions < self.n) & (self.places[at] == wanted)


def _anchors(counts: np.ndarray, width: int) -> list[int]:
    """Places such that every window of ``width`` words holds one, rarest terms first."""
    n, out, covered = len(counts), [], np.zeros(max(0, len(counts) - width + 1), bool)
    for place in np.argsort(counts, kind="stable"):
        low, high = max(0, place - width + 1), min(place, n - width) + 1
        if not covered[low:high].all():
            covered[low:high] = True
            out.append(int(place))
            if covered.all():
                break
    return out


def _rare(counts: np.ndarray, min_words: int, span: int) -> np.ndarray:
    """Which words of an item are not among its most frequent: at most half of ``min_words`` in any span are left out."""
    n = len(counts)
    common = np.zeros(n + 2 * span, np.int64)
    for p in np.argsort(-counts, kind="stable"):
        common[span + p] = 1
        near = np.concatenate([[0], np.cumsum(common[p + 1 : p + 2 * span])])
        if (near[span:] - near[:-span]).max() > min_words // 2:
            common[span + p] = 0
    return common[span : span + n] == 0


class _Items:
    """All test items behind one another, a gap after each, with their anchors and rare words by counts of the whole index."""

    def __init__(self, items: list[np.ndarray], counts: list[np.ndarray], min_words: int, slop: int) -> None:
        self.min_words, self.slop, self.items = min_words, slop, items
        self.starts = np.cumsum([0, *(len(q) + 1 for q in items)])
        self.words = np.concatenate([x for q in items for x in (q, np.zeros(1, np.int64))]) if items else np.empty(0, np.int64)
        self.gap = np.zeros(len(self.words), bool)
        self.gap[self.starts[1:] - 1] = True
        self.item_of = np.repeat(np.arange(len(items)), np.diff(self.starts))
        begins = self.starts[:-1].tolist()
        self.anchors = np.array([a + p for a, c in zip(begins, counts, strict=True) for p in _anchors(c, min_words)], np.int64)
        self.rare = np.concatenate([a + np.flatnonzero(_rare(c, min_words, min_words + slop)) for a, c in zip(begins, counts, strict=True)] or [np.empty(0, np.int64)])

    def local(self, seg: _Segment) -> np.ndarray:
        terms = seg.local(self.words)
        terms[self.gap] = -2
        return terms


def phrase_matches(seg: _Segment, items: _Items) -> Iterator[tuple[int, int, int, int]]:
    """(document number, item number, item's first word, words) of the longest exact run of each document and item.

    The lists of the rarest terms are intersected with those of the item's next words to both sides, moved by their
    distance in the item, as long as something is left.
    """
    terms = items.local(seg)
    which, at = seg.lists(terms[items.anchors])
    place = items.anchors[which]
    doc = seg.doc_of[at]
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for run, step in ((left, -1), (right, 1)):
        live, k = np.arange(len(at)), 0
        while len(live):
            k += 1
            to, word = at[live] + step * k, place[live] + step * k
            ok = (to >= 0) & (to < seg.n) & (word >= 0)  # after the last word comes a gap
            live, to, word = live[ok], to[ok], word[ok]
            live = live[seg.hold(terms[word], to) & (seg.doc_of[to] == doc[live])]
            run[live] = k
    whole = left + right + 1
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for j in np.flatnonzero(whole >= items.min_words):
        item = int(items.item_of[place[j]])
        found = (int(whole[j]), -int(place[j] - left[j] - items.starts[item]))
        best[int(doc[j]), item] = max(found, best.get((int(doc[j]), item), found))
    for (d, item), (w, start) in best.items():
        yield d, item, -start, w


def proximity_matches(seg: _Segment, items: _Items) -> Iterator[tuple[int, int, int, int]]:
    """(document number, item number, item's first word, words) where at least ``min_words`` words of a window of
    ``min_words + slop`` words of the item stand in the same order with at most ``slop`` words put in or left out.

    Positions are brought to a diagonal (position less place in the item); words of one passage lie on diagonals at
    most ``slop`` apart. The lists of all items' rare words are walked together first, the others only in what
    they leave: pairs of an item and a band of diagonals that hold enough of them.
    """
    terms, slop, least = items.local(seg), items.slop, items.min_words
    width, bands = int(np.diff(items.starts).max(initial=1)), seg.n // (slop + 1) + 1
    bands += 2 * width // (slop + 1) + 3

    def pairs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, place in its item, and (item, document, band) of all postings of some words."""
        which, at = seg.lists(terms[places])
        item = items.item_of[places[which]]
        place = places[which] - items.starts[item]
        return at, place, (item.astype(np.int64) * (len(seg.doc_starts) + 1) + seg.doc_of[at]) * bands + (at - place + width) // (slop + 1)

    # a passage lies in one band of slop + 1 diagonals or in two neighbours: bands with too few rare words end here
    keys, count = np.unique(pairs(items.rare)[2], return_counts=True)
    follows = np.append(keys[1:] == keys[:-1] + 1, False)[: len(keys)]
    rich = count + np.where(follows, np.append(count[1:], 0)[: len(keys)], 0) >= least - least // 2
    keys = np.unique(np.concatenate([keys[rich], keys[rich] + 1]))
    if not len(keys):
        return
    for item in np.unique(keys // bands // (len(seg.doc_starts) + 1)).tolist():
        at, place, key = pairs(np.arange(items.starts[item], items.starts[item + 1] - 1))
        keep = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
        at, place = at[keep], place[keep]
        doc = seg.doc_of[at]
        order = np.lexsort((place, at))
        at, place, doc = at[order], place[order], doc[order]
        span = least + slop
        last = np.searchsorted(at, at + span, side="left")
        best: dict[int, tuple[int, int]] = {}
        for j in np.flatnonzero(last - np.arange(len(at)) >= least):
            d = int(doc[j])
            part = slice(j, int(last[j]))
            off = (at[part] - place[part]) - (at[j] - place[j])
            ok = (np.abs(off) <= slop) & (doc[part] == d) & (place[part] >= place[j]) & (place[part] < place[j] + span)
            if ok.sum() < least:
                continue
            tails: list[int] = []  # longest strictly rising run of item places
            for p in place[part][ok].tolist():
                tails[(k := bisect_left(tails, p)) : k + 1] = [p]
            if len(tails) >= least and len(tails) > best.get(d, (0, 0))[1]:
                best[d] = (int(place[j]), len(tails))
        for d, (start, w) in best.items():
            yield d, item, start, w


def _segments(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[list]:
    for r in range(batch.num_rows):
        yield [batch.column(c)[r].values if c == "doc_ids" else batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in names]


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Postings in the whole index of some (sorted) terms. The terms are those of the test items: a bounded set."""
    n = len(terms)
    if not n:
        return np.empty(0, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for own, starts in _segments(batch, ("terms", "term_starts")):
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                total += np.where(own[at] == terms, np.diff(starts)[at], 0)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["t", "n"])

    got = index.select("terms", "term_starts").mapInArrow(count, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n, np.int64)
    out[got.column("t").to_numpy()] = got.column("n").to_numpy()
    return out


def search_index(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "item_text", min_words: int = MIN_WORDS, slop: int | None = None) -> DataFrame:
    """doc_id, item_id, item_start (word of the item), n_words of the longest match of each document and item.

    ``index``: a stored table of segments; it is read twice, the first time for the items' term counts only. Exact
    runs of at least ``min_words`` words; with ``slop``, proximity matches instead. Items are held-out test sets of
    a fixed size: they go to every task, after a check of their bytes (over the bound a ``ValueError`` tells so;
    search them in several calls). Items with a null id or under ``min_words`` words match nothing.
    """
    held = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    size = held.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"{size} bytes of test items; search at most {MAX_ITEM_BYTES} at once")
    ids = WordIds()
    queries = [(r.i, np.fromiter((ids[w] for w in words(r.t)), np.uint64).view(np.int64)) for r in held.distinct().collect()]
    queries = [(i, q) for i, q in queries if len(q) >= min_words]
    item_ids = [i for i, _ in queries]
    terms = np.unique(np.concatenate([q for _, q in queries])) if queries else np.empty(0, np.int64)
    counts = term_counts(index, terms)
    flat = _Items([q for _, q in queries], [counts[np.searchsorted(terms, q)] for _, q in queries], min_words, slop or 0)
    doc_type, item_type = index.schema["doc_ids"].dataType.elementType.simpleString(), held.schema["i"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for arrays in _segments(batch, _ARRAYS):
                seg = _Segment(*arrays)
                matches = phrase_matches(seg, flat) if slop is None else proximity_matches(seg, flat)
                out += [(seg.doc_ids[d].as_py(), item_ids[i], start, w) for d, i, start, w in matches]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kind = batch.schema.field("doc_ids").type.value_type
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string() if item_type == "string" else pa.int32() if item_type == "int" else pa.int64()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "item_id", "item_start", "n_words"])

    found = index.mapInArrow(search, f"doc_id {doc_type}, item_id {item_type}, item_start bigint, n_words bigint")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", (-F.col("item_start")).alias("s"))).alias("m")).select("doc_id", "item_id", (-F.col("m.s")).alias("item_start"), F.col("m.n_words").alias("n_words"))
