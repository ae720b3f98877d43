"""Lengths of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's pieces are split before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 1_000_000


@lru_cache(maxsize=2)
def encoding(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("quire", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Counts tokens word by word and remembers words.

    A token never reaches over a single space between two other characters except as the space it begins with, so a
    text cut before such spaces has the tokens of its parts. Texts with other white space at a cut are encoded whole.
    """

    def __init__(self, path: str = TOKENIZER):
        self.encode = encoding(path).encode_ordinary
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = text.split(" ")
        known, total, first = self.known, 0, True
        for p in parts:
            if not p or p[0].isspace() or p[-1].isspace():
                return len(self.encode(text))
            key = p if first else " " + p
            first = False
            n = known.get(key)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = n = len(self.encode(key))
            total += n
        return total


def token_sizes(documents: DataFrame, keep: list[str], path: str = TOKENIZER, text: str = "text") -> DataFrame:
    """``keep`` columns and ``tokens`` of every row; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = Counter(path)
        for pdf in batches:
            yield pdf[keep].assign(tokens=np.fromiter(map(count, pdf.pop("_t").tolist()), np.int64, len(pdf)))

    kinds = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return documents.select(*keep, F.col(text).alias("_t")).mapInPandas(run, f"{kinds}, tokens long")
