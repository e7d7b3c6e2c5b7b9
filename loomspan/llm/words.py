"""Words of a text: runs of letters and digits, without regard to case and combining marks."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

# the class stays in the basic plane, as wider classes are matched by a linear search; far marks are looked up
_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c)[0] == "M") + "]+")
_FAR = re.compile("[\U00010000-\U0010ffff]")
_ASCII_RUN = re.compile(r"[a-z0-9]+")
_RUN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, NFKD, combining marks removed (and lower case again: NFKD may give capitals)."""
    out = _MARKS.sub("", unicodedata.normalize("NFKD", text.lower()))
    return _FAR.sub(lambda m: "" if unicodedata.category(m[0])[0] == "M" else m[0], out).lower()


def words(text: str | None) -> list[str]:
    """The words of a text in order; ``[]`` for null, empty and blank texts."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_RUN.findall(text.lower())
    return _RUN.findall(fold(text))


class WordIds(dict):
    """64-bit ids of words, the same in every process; the cache is emptied when it grows large."""

    LIMIT = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        return self._ids(words(text))

    def of_folded(self, text: str) -> np.ndarray:
        """The same for a text (or a line of one) that has been folded already."""
        return self._ids((_ASCII_RUN if text.isascii() else _RUN).findall(text))

    def _ids(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words; shorter texts give one run of all their words."""
    if not len(ids):
        return ids
    width = min(width, len(ids))
    n = len(ids) - width + 1
    out = ids[:n].copy()
    for k in range(1, width):
        out = mix64(out) + ids[k : n + k]
    return mix64(out)
