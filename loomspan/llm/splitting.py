"""Problem 6: items over a size limit cut at natural boundaries, by recursive bisection."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.partitions import spread

LIMIT, OVERLAP = 1200, 200

#: Boundaries by falling strength: blank line, line break, end of a sentence, of a clause, of a word.
_BOUNDARY = re.compile(
    r"(?P<p5>[^\S\n]*\n[^\S\n]*\n\s*)|(?P<p4>[^\S\n]*\n[^\S\n]*)"
    r"|(?P<p3>(?:[.!?؟۔…]+[\"'”’»)\]]*[^\S\n]+)|[。！？]+[」』”’）]*[^\S\n]*)"
    r"|(?P<p2>[,;:،؛]+[^\S\n]+|[，；：、][^\S\n]*)|(?P<p1>[^\S\n]+)"
)
#: How far (as a share of the piece) a boundary may lie from the middle and still win over the next weaker kind.
_WEIGHT = np.array([0.0, 0.0, 0.08, 0.2, 0.3, 0.42])


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions after each natural boundary, their strengths (1 word to 5 blank line), and where the whitespace
    that belongs to them begins."""
    found = [(m.end(), int(m.lastgroup[1]), m.start() + len(m[0].rstrip())) for m in _BOUNDARY.finditer(text)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.array(found, np.int64)
    return a[:, 0], a[:, 1], a[:, 2]


def _cut(text: str, low: int, high: int, room: int, at: np.ndarray, strength: np.ndarray, space: np.ndarray) -> int:
    """Where to cut ``text[low:high]``: the strongest boundary near the middle, however far it is. Inside a word only
    if the run without a boundary around the middle is too long for a piece, so that it must be cut anyway."""
    a, b = np.searchsorted(at, [low + 1, high], side="left")
    middle = (low + high) // 2
    k = int(np.searchsorted(at[a:b], middle, side="right"))
    before = int(at[a + k - 1]) if k else low
    after = int(space[a + k]) if a + k < b else high
    if b == a or after - before > room:
        return _hard(text, (before + after) // 2, low)
    off = np.abs(at[a:b] - (low + high) / 2) / (high - low)
    best = a + int(np.argmax(_WEIGHT[strength[a:b]] - off))
    cut, shorter = int(at[best]), int(space[best])
    return shorter if low < shorter < cut and shorter - low <= room < cut - low else cut


def _hard(text: str, at: int, low: int) -> int:
    """A cut inside a word, moved back so that combining marks and joiners stay with their letter."""
    while at > low + 1 and (unicodedata.category(text[at])[0] == "M" or text[at] == "\u200d" or text[at - 1] == "\u200d"):
        at -= 1
    return at


def bisect_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(start, core_start, end)`` of the pieces of a text, in order.

    Cores follow one another without gap, so that joining ``text[core_start:end]`` gives the text back;
    ``text[start:core_start]`` is the overlap with the piece before. ``end - start <= limit``.
    A text within the limit is one piece; an empty one has none.
    """
    n = len(text)
    if not n:
        return []
    if n <= limit:
        return [(0, 0, n)]
    room = limit - overlap
    at, strength, space = boundaries(text)
    cores, stack = [], [(0, n)]
    while stack:
        low, high = stack.pop()
        size = high - low
        if size <= room:
            cores.append((low, high))
            continue
        cut = _cut(text, low, high, room, at, strength, space)
        stack += [(cut, high), (low, cut)]
    out = []
    for k, (low, high) in enumerate(cores):
        start = low
        if k and overlap:
            a, b = np.searchsorted(at, [low - overlap, low], side="left")
            start = int(at[a]) if b > a else _hard(text, low - overlap, 0)
            if low - start > overlap:  # _hard moved past the allowed overlap
                start = low
        out.append((start, low, high))
    return out


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Numbered pieces of every item: ``keys``, chunk_index, start_pos, core_pos, end_pos, content, n_pieces.

    Positions count code points. Items within the limit become one piece in the JVM; only oversized
    ones go to Python. Each whole row counts once; rows with a null text, and empty texts, have no
    piece; blank texts are kept as they are. Other columns, whatever their names, are dropped.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    item = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t")).where(F.length("t") > 0)
    kept = [f"k{i}" for i in range(len(keys))]
    size = F.length("t")
    small = item.where(size <= limit).select(*kept, F.lit(0).cast("long").alias("chunk_index"), F.lit(0).cast("long").alias("start_pos"), F.lit(0).cast("long").alias("core_pos"), size.cast("long").alias("end_pos"), F.col("t").alias("content"), F.lit(1).cast("long").alias("n_pieces"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, start, core, end, content, n = [], [], [], [], [], [], []
            for r, t in enumerate(batch.column("t").to_pylist()):
                pieces = bisect_text(t, limit, overlap)
                for k, (s, c, e) in enumerate(pieces):
                    rows.append(r), index.append(k), start.append(s), core.append(c), end.append(e), content.append(t[s:e]), n.append(len(pieces))
            taken = batch.select(kept).take(pa.array(rows, pa.int64()))
            numbers = [pa.array(x, pa.int64()) for x in (index, start, core, end)]
            yield pa.RecordBatch.from_arrays([*taken.columns, *numbers, pa.array(content, pa.string()), pa.array(n, pa.int64())], names=[*kept, "chunk_index", "start_pos", "core_pos", "end_pos", "content", "n_pieces"])

    large = spread(item.where(size > limit)).mapInArrow(cut, small.schema)
    out = small.unionByName(large)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "chunk_index", "start_pos", "core_pos", "end_pos", "content", "n_pieces")
