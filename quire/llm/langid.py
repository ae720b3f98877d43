"""Language of works, files and foreign segments, word by word with back-off to character n-grams.

A known word scores its log frequency in each language; an unseen word scores the average of its longest known
character n-grams, from five letters down to one. Sentences take the language of the highest sum; a book's main
language is that of most of its words.

The model is fitted on at most LABEL_BLOCKS blocks of each label (the first TRAIN_CHARS characters of each) and
BOOK_BLOCKS of each book, drawn by hash. Labels are partly wrong, so a book whose words are those of another label's
books takes that label, and the fit is repeated with the sample's own sentences labelled by the previous fit. A
language goes only if none of its books keeps it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.llm.hashing import code_points, letter_table, slices, word_hashes
from quire.runtime import discard, materialize

LABEL_BLOCKS, BOOK_BLOCKS, TRAIN_CHARS, ROUNDS = 1_000, 8, 2_000, 3
#: Least cosine of a book's words with those of another label's books for it to take that label, and how much nearer
#: than its own label's other books a label of fewer books must be; one of more books may be as much farther.
SAME, NEARER = 0.6, 0.1
LONGEST = 5
MIN_BOOK_WORDS, MIN_SEGMENT_WORDS = 100, 15
#: A sentence counts as foreign if it is this many nats likelier in the other language, in total.
MARGIN = 4.0

#: ISO 639-2 codes and names by two-letter code, and labels that say nothing.
ISO3 = {
    "en": "eng", "de": "deu ger", "fr": "fra fre", "es": "spa", "it": "ita", "pt": "por", "ru": "rus", "nl": "nld dut", "bg": "bul", "uk": "ukr",
    "pl": "pol", "cs": "ces cze", "sv": "swe", "da": "dan", "no": "nor", "fi": "fin", "el": "ell gre", "tr": "tur", "hu": "hun", "ro": "ron rum",
    "ca": "cat", "la": "lat", "gl": "glg", "sr": "srp", "hr": "hrv", "sk": "slk slo", "sl": "slv", "et": "est", "lv": "lav", "lt": "lit",
}
NAMES = {"en": "english", "de": "german deutsch", "fr": "french français francais", "es": "spanish español espanol castellano", "it": "italian italiano", "pt": "portuguese português portugues", "ru": "russian русский", "nl": "dutch nederlands"}
NO_LABEL = ("", "und", "unknown", "mul", "zxx", "mis", "none", "null", "n/a", "na", "-", "?", "xx", "unk")


def norm_label(label: Column) -> Column:
    """Two-letter code of a language label in any notation; null where it says nothing."""
    head = F.split(F.regexp_replace(F.lower(F.trim(label)), "_", "-"), "-")[0]
    table = F.create_map(*[F.lit(x) for two, three in ISO3.items() for one in f"{three} {NAMES.get(two, '')}".split() for x in (one, two)])
    code = F.coalesce(F.try_element_at(table, head), head)
    return F.when(F.lower(F.trim(label)).isin(*NO_LABEL) | ~code.rlike("^[a-z]{2}$") | code.isin("xx"), None).otherwise(code)


class LanguageModel:
    """Scores of known words by hash, and of n-grams of unseen ones."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        n = len(self.langs)
        vocabulary = sorted(set().union(*counts.values()))
        table = np.array([[counts[l][w] for l in self.langs] for w in vocabulary], float).reshape(len(vocabulary), n)
        total = np.maximum(table.sum(0), 1.0)
        mean = (table.sum(1) / max(table.sum(), 1.0))[:, None]
        # shrunk to the word's share over all languages, so that a small language isn't sure of anything
        scores = np.log((table + 200.0 * mean + 1e-3) / (total + 200.0)[None, :])
        self.flat = np.full(n, -9.0, np.float32)
        grams: dict[str, np.ndarray] = {}
        size = np.zeros((LONGEST + 1, n))
        for w, row in zip(vocabulary, table):
            padded = f" {w} "
            for k in range(1, LONGEST + 1):
                for i in range(len(padded) - k + 1):
                    g = padded[i : i + k]
                    if g in grams:
                        grams[g] += row
                    else:
                        grams[g] = row.copy()
                    size[k] += row
        every = size.sum(1)
        self.grams = {}
        for g, row in grams.items():
            if row.sum() >= 3:
                share = row.sum() / max(every[len(g)], 1.0)
                self.grams[g] = np.log((row + 200.0 * share + 1e-3) / (size[len(g)] + 200.0)).astype(np.float32)
        if vocabulary:
            hashes, first, _, _ = word_hashes(vocabulary)
            ok = np.diff(first) == 1
            hashes, scores = hashes[first[:-1][ok]], scores[ok]
            order = np.argsort(hashes)
            self.hashes, self.scores = hashes[order], scores[order].astype(np.float32)
        else:
            self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros((0, n), np.float32)

    def unseen(self, word: str) -> np.ndarray:
        padded = f" {word} "
        for k in range(LONGEST, 0, -1):
            rows = [self.grams[g] for i in range(len(padded) - k + 1) if (g := padded[i : i + k]) in self.grams]
            if rows:
                rows = np.mean(rows, axis=0)
                return rows - rows.max() + self.flat.max()
        return self.flat


#: A word parted at a line's end, a run of single letters (a head set with spaces), and a line of nothing but a number.
_PARTED = re.compile(r"(?<=[^\W\d_])[-\xad¬‐][ \t]*\n[ \t]*(?=[^\W\d_])")
_SPACED = re.compile(r"(?:(?<!\w)[^\W\d_]\s+){5,}")
_NUMBER_LINE = re.compile(r"\W*(?:\w{1,5}\.?\s+)?(?:\d{1,5}|[ivxlcIVXLC]{1,8})\W*")
#: A first or last line of less than this share of the longest one may be a head, and its words no part of a sentence.
SHORT_LINE = 0.75


def running_text(text: str) -> str:
    """A page's text as it was written: parted words joined, letter-spaced heads and lines of a number left out, and
    short outer lines and paragraphs closed by a full stop, so that no head runs into a sentence."""
    if "\n" not in text:
        return text
    lines = text.split("\n")
    full = SHORT_LINE * max(map(len, lines))
    filled = [k for k, x in enumerate(lines) if x.strip()]
    outer = {*filled[:2], *filled[-2:]}
    made: list[str] = []
    for k, line in enumerate(lines):
        bare = line.strip()
        if bare and k in outer and len(filled) > 1 and (_SPACED.search(bare) or _NUMBER_LINE.fullmatch(bare)):
            continue
        if not bare and made and made[-1][-1:] not in ".":
            made[-1] += "."
        elif bare:
            head = k == filled[0] and len(bare) < full and bare[-1] not in "-\xad¬‐"
            if made and k == filled[-1] and len(bare) < full and bare[:1].isupper() and made[-1].rstrip()[-1] not in "-\xad¬‐.":
                made[-1] += "."
            made.append(bare + "." if head else bare)
    return _PARTED.sub("", "\n".join(made))


_ENDS = np.zeros(0x110000, bool)
_ENDS[[ord(c) for c in ".!?…"]] = True
_SPACE = np.zeros(0x110000, bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True


class Scorer:
    """Sentences of texts with their words and scores; unseen words are remembered up to a fixed number."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.unseen = lru_cache(maxsize=200_000)(model.unseen)

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per sentence: its text, letter words, words between white space, scores (one column a language)."""
        texts = [running_text(t or "").lower() for t in texts]
        codes, begins = code_points(texts)
        words, first, start, end = word_hashes(texts)
        n = len(self.model.langs)
        if not len(words):
            z = np.zeros(0, np.int64)
            return z, z, z, np.zeros((0, n), np.float32)
        space = _SPACE[codes]
        after = np.append(space[1:], True)
        second = np.append(after[1:], True)
        letter = letter_table()[codes]
        stop = _ENDS[codes] & (after | (second & ~np.append(letter[1:], False)))
        stop[begins[1:] - 1] = True
        number = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(stop, out=number[1:])
        of_word = number[start]
        cut = np.flatnonzero(np.append(True, of_word[1:] != of_word[:-1]))
        at = np.minimum(np.searchsorted(self.model.hashes, words), max(len(self.model.hashes) - 1, 0))
        known = self.model.hashes[at] == words if len(self.model.hashes) else np.zeros(len(words), bool)
        score = self.model.scores[at] if len(self.model.hashes) else np.zeros((len(words), n), np.float32)
        joined = "\n".join(texts)
        for i in np.flatnonzero(~known):
            score[i] = self.unseen(joined[start[i] : end[i]])
        sums = np.add.reduceat(score, cut, axis=0)
        count = np.diff(np.append(cut, len(words)))
        # words between white space of the same sentences
        piece = np.flatnonzero(~space & np.append(True, space[:-1]))
        ids = of_word[cut]
        pieces = np.bincount(np.searchsorted(ids, number[piece]).clip(0, len(ids) - 1), minlength=len(ids))
        owner = np.searchsorted(begins, start[cut], side="right") - 1
        return owner, count, pieces, sums


def fit(texts: list[str], labels: list[str], books: list[int]) -> LanguageModel:
    """Fit on labelled texts of books, then refit on the distinct sentences as the previous fit labels them. Labels of
    more books, in all and not only of those given here, stand before those of fewer."""
    split = re.compile(r"[^\W\d_]+")
    each = [re.split(r"(?<=[.!?…])\s+", running_text(t)) for t in texts]
    # a sentence printed in books of several labels, such as a notice, tells nothing of any of them
    of: dict[str, set[str]] = defaultdict(set)
    for xs, label in zip(each, labels):
        for x in xs:
            of[x].add(label)
    telling = (split.findall(" ".join(x for x in dict.fromkeys(xs) if len(of[x]) == 1).lower()) for xs in each)
    counts = _by_label(telling, list(zip(books, labels)))
    model = LanguageModel(counts)
    parts = [x for x in of if x]
    words = [split.findall(x.lower()) for x in parts]
    for _ in range(ROUNDS - 1):
        owner, _, _, sums = Scorer(model).sentences(parts)
        total = np.zeros((len(parts), len(model.langs)))
        np.add.at(total, owner, sums)
        # a language that gets no sentence keeps its words
        made: dict[str, Counter] = defaultdict(Counter)
        for ws, k, seen in zip(words, total.argmax(1), total.any(1)):
            if seen and len(ws) > 3:
                made[model.langs[k]].update(ws)
        counts = {k: made.get(k, c) for k, c in counts.items()}
        model = LanguageModel(counts)
    return model


def _by_label(texts: Iterator[list[str]], keys: list[tuple[int, str]]) -> dict[str, Counter]:
    """Words by label, after books with the words of another label's books have taken that label. A book is never
    compared with its own words; a label of one book, like none of the others, stays. ``keys``: book and label by text,
    the label of most books first: as many books are drawn of every common label, so how many came says nothing."""
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in texts]
    every = sorted({k for k, x in zip(keys, ids) if len(x)})
    langs = sorted({k[1] for k in every})
    if not every:
        return {}
    at = {k: i for i, k in enumerate(every)}
    size = len(number)
    cells, n = np.unique(np.concatenate([x + at[k] * size for k, x in zip(keys, ids) if len(x)]), return_counts=True)
    row, col, n = cells // size, cells % size, n.astype(float)
    starts = np.searchsorted(row, np.arange(len(every)))
    norm = np.add.reduceat(n * n, starts)
    own = np.array([langs.index(k[1]) for k in every])
    me = np.arange(len(every))
    falling = list(dict.fromkeys(k[1] for k in keys))
    rank = np.array([falling.index(k) for k in langs])

    def pools() -> np.ndarray:
        return np.stack([np.bincount(col[mine], n[mine], size) for mine in (own[row] == k for k in range(len(langs)))])

    for _ in range(ROUNDS):
        pool = pools()
        dot = np.stack([np.add.reduceat(n * p[col], starts) for p in pool], axis=1)
        square = (pool * pool).sum(1)
        near = dot / np.maximum(np.sqrt(norm[:, None] * square[None, :]), 1e-9)
        rest = np.maximum(square[own] - 2 * dot[me, own] + norm, 0)
        alone = (dot[me, own] - norm) / np.maximum(np.sqrt(norm * rest), 1e-9)
        need = alone[:, None] + np.where(rank[None, :] < rank[own][:, None], -NEARER, NEARER)
        near[(near < SAME) | (near <= need)] = -1
        near[me, own] = -1
        best = near.argmax(1)
        moves = near[me, best] > 0
        if not moves.any():
            break
        own = np.where(moves, best, own)
    words = list(number)
    return {langs[k]: Counter({words[i]: int(p[i]) for i in np.flatnonzero(p)}) for k, p in enumerate(pools()) if p.any()}


def train(blocks: DataFrame, books: DataFrame) -> LanguageModel:
    labelled = books.select(F.col("id").alias("book_id"), norm_label(F.col("language")).alias("label")).where("label IS NOT NULL").distinct()
    # keys first, so that only the drawn texts are ever moved; books are drawn with all of their blocks, as one block is
    # too few words to tell a wrong label by, and there are the more books of a wrong label the larger the tables
    written = blocks.where("text IS NOT NULL AND text <> ''")
    keys = written.select("book_id", "seq").distinct().join(labelled, "book_id").withColumn("h", F.xxhash64("book_id", "seq"))
    keys = keys.withColumn("nth", F.row_number().over(W.partitionBy("label", "book_id").orderBy("h", "seq"))).where(F.col("nth") <= BOOK_BLOCKS)
    keys = keys.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("book_id"), "book_id", "nth"))).where(F.col("rank") <= LABEL_BLOCKS)
    keys = materialize(keys.select("book_id", "seq", "label"))
    drawn = written.select("book_id", "seq", F.substring("text", 1, TRAIN_CHARS).alias("text"))
    sample = drawn.join(F.broadcast(keys), ["book_id", "seq"]).dropDuplicates(["label", "book_id", "seq"]).select("label", "book_id", "text").toPandas()
    discard(keys)
    # of two labels with as many books the first in the alphabet counts as the larger
    sizes = written.select("book_id").distinct().join(labelled, "book_id").groupBy("label").agg(F.countDistinct("book_id").alias("books"))
    falling = [r.label for r in sizes.orderBy(F.desc("books"), "label").collect()]
    sample = sample.iloc[sample["label"].map({k: i for i, k in enumerate(falling)}).argsort(kind="stable")]
    return fit(sample["text"].tolist(), sample["label"].tolist(), sample["book_id"].tolist())


def block_languages(blocks: DataFrame, model: LanguageModel) -> DataFrame:
    """Per block ``book_id, seq``, words by language as pieces between white space (``w0``, ``w1``, ...), of
    sentences that are foreign beyond doubt (``f``: those of the block by language) and the mean margin."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    n = len(model.langs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(shared.value)
        for pdf in slices(batches):
            owner, count, pieces, sums = score.sentences(pdf["text"].tolist())
            out = np.zeros((len(pdf), n), np.int64)
            margins = np.zeros(len(pdf))
            if len(owner):
                best = sums.argmax(1)
                np.add.at(out, (owner, best), pieces)
                top = np.partition(sums, -2, axis=1) if n > 1 else np.hstack([sums - 99, sums])
                np.add.at(margins, owner, np.minimum(top[:, -1] - top[:, -2], 50.0))
            made = {"book_id": pdf["book_id"], "seq": pdf["seq"], "margin": margins}
            for k in range(n):
                made[f"w{k}"] = out[:, k]
            # sentences against every other language: words of those that beat it by MARGIN
            sure = np.zeros((len(pdf), n, n), np.int64)
            if len(owner):
                for main in range(n):
                    clear = sums[np.arange(len(owner)), best] - sums[:, main] >= MARGIN
                    np.add.at(sure[:, main, :], (owner[clear], best[clear]), pieces[clear])
            made["f"] = [x.ravel().tolist() if foreign else None for x, foreign in zip(sure, (out > 0).sum(1) > 1)]
            yield pd.DataFrame(made)

    slim = blocks.select("book_id", F.col("seq").cast("int").alias("seq"), "text")
    columns = ", ".join(f"w{k} long" for k in range(n))
    return slim.mapInPandas(run, f"book_id long, seq int, margin double, {columns}, f array<long>")


def languages(blocks: DataFrame, books: DataFrame, model: LanguageModel | None = None) -> tuple[DataFrame, DataFrame]:
    """Per book ``book_id, lang, words, confidence`` and per foreign segment ``book_id, seq, lang, words, confidence``.

    Confidence is the share of the book's words in its main language, and of a segment's words that are foreign beyond
    doubt among those of its language in the block. Repeated block rows count once; null and
    empty texts have no words and get no language; ties go to the language first in the alphabet.
    """
    model = model or train(blocks, books)
    n, langs = len(model.langs), model.langs
    each = materialize(block_languages(blocks.where("book_id IS NOT NULL"), model).dropDuplicates(["book_id", "seq"]))
    sums = each.groupBy("book_id").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(n)])
    every = F.array(*[F.col(f"w{k}") for k in range(n)])
    names = F.array(*[F.lit(x) for x in langs])
    at = F.array_position(every, F.array_max(every)).cast("int")
    total = sum((F.col(f"w{k}") for k in range(n)), F.lit(0))
    book = sums.select("book_id", (at - 1).alias("main"), F.element_at(names, at).alias("lang"), total.alias("words"), F.round(F.array_max(every) / total, 6).alias("confidence")).where("words > 0")
    # the words clearly foreign against the book's main language, or all words of a block without any of it
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(F.col("f").isNull(), F.element_at(every, k + 1)).otherwise(F.element_at(F.col("f"), F.col("main") * n + k + 1)))
    mixed = each.join(book.select("book_id", "main"), "book_id").select("book_id", "seq", "main", every.alias("all"), F.posexplode(own).alias("k", "words"))
    sure = F.round(F.col("words") / F.greatest("words", F.element_at("all", F.col("k") + 1)), 6)
    segments = mixed.where("k <> main").where(F.col("words") >= MIN_SEGMENT_WORDS).select("book_id", "seq", F.element_at(names, F.col("k") + 1).alias("lang"), "words", sure.alias("confidence"))
    return book.select("book_id", "lang", "words", "confidence"), segments


def newest_files(files: DataFrame) -> DataFrame:
    """The last surveyed row of each path; exact copies count once, and rows without a path are left out."""
    w = W.partitionBy("path").orderBy(F.col("surveyed_at").desc_nulls_last(), F.xxhash64("language", "sha256"))
    return files.where("path IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def assigned(blocks: DataFrame, books: DataFrame, files: DataFrame, book_files: DataFrame) -> DataFrame:
    """``rec_table, rec_key, lang, confidence, label`` of every work and file with enough words, and of every
    foreign segment (whose label is the book's main language)."""
    book, segments = languages(blocks, books)
    book = materialize(book)
    enough = book.where(F.col("words") >= MIN_BOOK_WORDS)
    of_books = books.select(F.col("id").alias("book_id"), norm_label(F.col("language")).alias("label")).join(enough, "book_id")
    of = book_files.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("book_id").alias("book_id"))
    slim = newest_files(files.select("path", "sha256", "language", "surveyed_at"))
    of_files = slim.join(of, "sha256").join(enough, "book_id").select("path", norm_label(F.col("language")).alias("label"), "lang", "confidence")
    main = book.select("book_id", F.col("lang").alias("label"), "words")
    of_blocks = segments.select("book_id", "seq", "lang", "confidence").join(main, "book_id")
    return (
        of_books.select(F.lit("books").alias("rec_table"), F.col("book_id").cast("string").alias("rec_key"), "lang", "confidence", "label")
        .unionByName(of_files.select(F.lit("files").alias("rec_table"), F.col("path").alias("rec_key"), "lang", "confidence", "label"))
        .unionByName(of_blocks.select(F.lit("blocks").alias("rec_table"), F.concat_ws("/", "book_id", "seq").alias("rec_key"), "lang", "confidence", "label"))
    )


def corrections(*tables: DataFrame) -> DataFrame:
    """Of ``assigned`` the rows whose label is missing or another language."""
    return assigned(*tables).where("label IS NULL OR label <> lang").select("rec_table", "rec_key", "lang").distinct()
