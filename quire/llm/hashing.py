"""Vectorised letter words and word windows.

A letter word is a maximal run of letters in the lower-cased text; a window is ``size`` successive
letter words. A whole batch of texts is turned into one array of code points, words are hashed by
prefix sums of a polynomial hash and windows by a rolling combination, so there is no Python loop
over words.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Beyond this code point there are no letters.
_ASSIGNED = 0x40000


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    found = np.zeros(sys.maxunicode + 1, bool)
    found[:_ASSIGNED] = [chr(c).isalpha() for c in range(_ASSIGNED)]
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        base = int(_ODD)
        for k, b in ((0, base), (1, pow(base, -1, 1 << 64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts joined by line feeds, and where each text begins (one more for the end)."""
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=begins[1:])
    joined = "\n".join(texts) + "\n"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), begins


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: word hashes, first word of each text (n + 1 entries), each word's begin and end
    as offsets into the joined code points. Null counts as empty."""
    codes, begins = code_points([(t or "").lower() for t in texts])
    inside = letter_table()[codes]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    power, inverse = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=total[1:])
    words = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return words, np.searchsorted(start, begins), start, end


def windows(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes and the first window of each text (n + 1 entries); no window crosses texts."""
    counts = np.maximum(np.diff(first) - (size - 1), 0)
    at = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=at[1:])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    every = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        every = every * _ODD + words[k : len(words) - size + 1 + k]
    keep = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
    return mix(every[keep]), at


def slices(batches, column: str = "text", chars: int = 1 << 20):
    """Arrow batches as smaller frames of about ``chars`` characters, so that numpy's temporaries stay small."""
    for pdf in batches:
        ends = pdf[column].str.len().fillna(0).to_numpy().cumsum() // chars
        cut = np.flatnonzero(np.append(True, ends[1:] != ends[:-1])) if len(pdf) else np.zeros(0, int)
        for a, b in zip(cut, np.append(cut[1:], len(pdf))):
            yield pdf.iloc[a:b].reset_index(drop=True)
