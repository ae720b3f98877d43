"""Repetition inside a single document, as covered characters and words.

Rolling hashes of several n-gram lengths are computed for a whole Arrow batch in numpy; a word or
character counts as repeated when it lies in an n-gram (or line) that occurred earlier in the same
document. One pass over the table, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.llm.hashing import code_points, mix, slices, windows, word_hashes

N_GRAMS = (2, 3, 5, 10)
WINDOW, MIN_WORDS, MIN_SHARE = 5, 20, 0.3


def _later(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True where the same owner has the same value at a smaller position."""
    if not len(values):
        return np.zeros(0, bool)
    key = mix(values ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    # the same value under the same owner gives the same key; distinct ones collide with 2**-64
    same = np.zeros(len(values), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    return same


def _covered(hit: np.ndarray, first_word: np.ndarray, at: np.ndarray, size: int, words: int) -> np.ndarray:
    """Words inside any hit window."""
    mark = np.zeros(words + 1, np.int64)
    counts = np.diff(at)
    place = np.repeat(first_word[:-1] - at[:-1], counts) + np.arange(at[-1])
    place = place[hit]
    np.add.at(mark, place, 1)
    np.add.at(mark, place + size, -1)
    return np.cumsum(mark[:-1]) > 0


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Per text: letter words, share of words in repeated windows of each length, shares of characters in
    repeated 5-word windows and in repeated lines."""
    n = len(texts)
    texts = [t or "" for t in texts]
    words, first, start, end = word_hashes(texts)
    n_words = np.diff(first)
    out: dict[str, np.ndarray] = {"n_words": n_words}
    length = end - start
    for size in N_GRAMS:
        grams, at = windows(words, first, size)
        hit = _later(grams, np.repeat(np.arange(n), np.diff(at)))
        covered = _covered(hit, first, at, size, len(words))
        for what, weight in (("words", covered.astype(np.int64)), ("chars", covered * length)):
            total = np.zeros(len(words) + 1, np.int64)
            np.cumsum(weight, out=total[1:])
            out[f"{what}_{size}"] = total[first[1:]] - total[first[:-1]]
    total = np.zeros(len(words) + 1, np.int64)
    np.cumsum(length, out=total[1:])
    out["letters"] = total[first[1:]] - total[first[:-1]]
    out |= _lines(texts)
    return out


def _lines(texts: list[str]) -> dict[str, np.ndarray]:
    lines = [[x for x in (y.strip() for y in t.split("\n")) if x] for t in texts]
    count = np.array([len(x) for x in lines], np.int64)
    flat = [x for y in lines for x in y]
    owner = np.repeat(np.arange(len(texts)), count)
    lengths = np.array([len(x) for x in flat], np.int64)
    if flat:
        codes, begins = code_points(flat)
        power = np.multiply.accumulate(np.full(int(lengths.max()) + 2, 0x9E3779B97F4A7C15, np.uint64))
        spot = np.arange(len(codes)) - np.repeat(begins[:-1], np.diff(begins))
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[spot], out=total[1:])
        hashes = mix(total[begins[1:]] - total[begins[:-1]])
        again = _later(hashes, owner)
    else:
        again = np.zeros(0, bool)
    repeated = np.bincount(owner, weights=again * lengths, minlength=len(texts))
    every = np.bincount(owner, weights=lengths, minlength=len(texts))
    return {"line_chars_repeated": repeated.astype(np.int64), "line_chars": every.astype(np.int64)}


def repetition(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: ``key``, ``n_words`` and the repeated shares (0 where there is nothing).

    Null and empty texts have no words and shares of 0; a null key is kept; copies of a row give equal
    rows; an empty table gives an empty one; other columns are ignored.
    """
    fields = ["n_words"] + [f"share_words_{n}" for n in N_GRAMS] + [f"share_chars_{n}" for n in N_GRAMS] + ["share_line_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "t"):
            m = measure(pdf["t"].tolist())
            made = {"k": pdf["k"], "n_words": m["n_words"]}
            for n in N_GRAMS:
                made[f"share_words_{n}"] = m[f"words_{n}"] / np.maximum(m["n_words"], 1)
                made[f"share_chars_{n}"] = m[f"chars_{n}"] / np.maximum(m["letters"], 1)
            made["share_line_chars"] = m["line_chars_repeated"] / np.maximum(m["line_chars"], 1)
            yield pd.DataFrame(made)[["k", *fields]]

    kind = documents.schema[key].dataType.simpleString()
    slim = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = f"k {kind}, n_words long, " + ", ".join(f"{f} double" for f in fields[1:])
    return slim.mapInPandas(run, schema).withColumnRenamed("k", key)


def repetitive(documents: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """Distinct ids of documents of at least ``min_words`` letter words whose share of words in repeated
    five-word windows reaches ``min_share``."""
    m = repetition(documents)
    return m.filter((F.col("n_words") >= min_words) & (F.col(f"share_words_{WINDOW}") >= min_share)).select("doc_id").distinct()
