"""Text decoded with the wrong character encoding: found and, as far as it survives, restored.

Adjacent character pairs are scored by their mutual information over the whole corpus; a pair no more frequent
than ``FLOOR`` of all pairs is unsupported, because damaged text brings its own pairs with high mutual
information. Maximum-scoring segments of improbable pairs give the runs; inverse mappings (encode with the wrong
encoding, decode with the right one) are tested only inside them, and one is accepted when the bigram
likelihood rises by ``GAIN`` bits (of single-byte swaps also by ``PER_CHAR`` a changed character or ``SURE``). A replacement character, which only a failed decoding leaves, always counts.

The pair table is a square of ``SLOTS`` slots (rarer code points share slots), so it is bounded whatever the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.llm.hashing import code_points, letter_table, mix, slices

SLOTS, DIRECT = 2048, 1344
FLOOR, GAIN, PER_CHAR, SURE, THETA = 5e-5, 7.0, 6.0, 30.0, -1.0
_BRIDGE = 0.25
LOST = "�"

#: Encodings that text was wrongly read in, and single-byte encodings it was written in.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "iso8859-5", "cp1254", "cp1257", "mac_cyrillic", "cp852", "iso8859-15")
WRITTEN_IN = ("cp1252", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "cp1250", "iso8859-5", "mac_cyrillic")


@lru_cache(maxsize=1)
def _slot_table() -> np.ndarray:
    codes = np.arange(0x110000, dtype=np.uint64)
    rest = DIRECT + (mix(codes) % np.uint64(SLOTS - DIRECT)).astype(np.int64)
    return np.where(codes < DIRECT, codes.astype(np.int64), rest).astype(np.int32)


def slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, begins = code_points(texts)
    return _slot_table()[codes], begins, codes


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SLOTS * SLOTS, np.int64)
    for pdf in slices(batches):
        ids, _, _ = slots([t or "" for t in pdf["text"]])
        pairs = ids[:-1] * SLOTS + ids[1:]
        for i in range(0, len(pairs), 1 << 22):
            total += np.bincount(pairs[i : i + (1 << 22)], minlength=SLOTS * SLOTS)
    have = np.flatnonzero(total)
    yield pd.DataFrame({"pair": have.astype(np.int32), "n": total[have]})


class PairModel:
    """Scores of all slot pairs: ``mutual`` in bits (unsupported pairs at -20) and ``follow`` = log2 p(b | a)."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        table = np.zeros(SLOTS * SLOTS)
        table[pairs] = counts
        table = table.reshape(SLOTS, SLOTS)
        left, right, total = table.sum(1), table.sum(0), max(table.sum(), 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            mutual = np.log2(table * total / (left[:, None] * right[None, :]))
        mutual[~np.isfinite(mutual) | (table < FLOOR * total)] = -20
        follow = np.log2((table + 0.02 * right[None, :] / total + 1e-4) / (left[:, None] + 0.1))
        self.mutual, self.follow = mutual.astype(np.float32).ravel(), follow.astype(np.float32).ravel()

    def likelihood(self, text: str) -> float:
        ids = _slot_table()[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), "<u4")]
        return float(self.follow[ids[:-1] * SLOTS + ids[1:]].sum())


def pair_model(texts: DataFrame) -> PairModel:
    """Pair counts over all rows of ``texts`` (column text); at most SLOTS**2 sums reach the driver."""
    made = texts.select("text").mapInPandas(_count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    return PairModel(made["pair"].to_numpy(), made["n"].to_numpy())


@lru_cache(maxsize=None)
def _to_byte(name: str) -> dict[str, str]:
    """Characters of a single-byte encoding to their byte as a character; undefined bytes as C1 controls."""
    found = {}
    for b in range(128, 256):
        try:
            found[bytes([b]).decode(name)] = chr(b)
        except UnicodeDecodeError:
            found[chr(b)] = chr(b)
    return found


@lru_cache(maxsize=None)
def _swap(read_as: str, written_in: str) -> dict[int, str] | None:
    table = {}
    for char, byte in _to_byte(read_as).items():
        try:
            table[ord(char)] = bytes([ord(byte)]).decode(written_in)
        except UnicodeDecodeError:
            table[ord(char)] = LOST
    return table if any(chr(a) != b for a, b in table.items()) else None


_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _as_utf8(run: str, read_as: str) -> str:
    table = _to_byte(read_as)
    raw = "".join(table.get(c, c if c < "\x80" else "Ā") for c in run)
    out, last = [], 0
    for m in _UTF8.finditer(raw):
        try:
            char = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [run[last : m.start()], char]
        last = m.end()
    return "".join([*out, run[last:]])


#: Hyphens at the end of a line are no damage.
_BREAK = re.compile("([\xac\xad](?=\n|$))")
_CYRILLIC, _LATIN = re.compile("[\u0400-\u04ff]"), re.compile("[A-Za-z]")


def _mixed(before: str, after: str) -> bool:
    """A mapping that brings Cyrillic letters into a mostly Latin run is no restoration."""
    new = len(_CYRILLIC.findall(after))
    return new > len(_CYRILLIC.findall(before)) and new < max(2, len(_LATIN.findall(after)))


@lru_cache(maxsize=1)
def _swaps() -> tuple[list[tuple[str, str]], np.ndarray]:
    """All single-byte swaps and their maps of the basic plane's code points."""
    pairs = [(a, b) for a in READ_AS for b in WRITTEN_IN if _swap(a, b)]
    maps = np.tile(np.arange(1 << 16, dtype=np.uint16), (len(pairs), 1))
    for row, pair in zip(maps, pairs):
        for a, b in _swap(*pair).items():
            row[a] = ord(b)
    return pairs, maps


@lru_cache(maxsize=None)
def _utf8_sets(name: str) -> tuple[frozenset, frozenset]:
    """Characters of an encoding that stand for first and for later bytes of UTF-8."""
    table = _to_byte(name)
    return frozenset(c for c, b in table.items() if "\xc2" <= b <= "\xf4"), frozenset(c for c, b in table.items() if b < "\xc0")


_JOINS = "’–—…"
_SIGNS = np.zeros(0x110000, bool)
_SIGNS[[ord(c) for c in "«»“”„‘’‚–—…"]] = True


def _likely_swaps(run: str, model: PairModel) -> list[tuple[str, str]]:
    """The swaps that raise the likelihood of the run by GAIN, the likeliest first; of those with one result the first."""
    codes = np.frombuffer((" " + run + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    wide = codes > 127
    wide[[m.start() + 1 for m in _BREAK.finditer(run)]] = False
    at = np.flatnonzero(wide)
    if not len(at):
        return []
    chars, kind = np.unique(codes[at], return_inverse=True)
    pairs, maps = _swaps()
    made = np.tile(chars, (len(pairs), 1))
    basic = chars < 1 << 16
    made[:, basic] = maps[:, chars[basic]]
    made, first = np.unique(made, axis=0, return_index=True)
    order = np.argsort(first)
    made, first = _slot_table()[made[order]].astype(np.int64), first[order]
    # columns of made for the changed characters, of the unchanged ones behind them
    base = _slot_table()[codes].astype(np.int64)
    column = np.arange(len(codes)) + len(chars)
    column[at] = kind
    left = np.unique(np.concatenate([at - 1, at]))
    gain = np.empty(len(made))
    before = model.follow[base[left] * SLOTS + base[left + 1]].sum(dtype=float)
    step = max(1, (1 << 20) // len(codes))
    for i in range(0, len(made), step):
        part = np.hstack([made[i : i + step], np.tile(base, (len(made[i : i + step]), 1))])
        gain[i : i + step] = model.follow[part[:, column[left]] * SLOTS + part[:, column[left + 1]]].sum(1, dtype=float) - before
    return [pairs[first[k]] for k in np.argsort(-gain, kind="stable") if gain[k] > GAIN - 0.01]


def _inside(run: str, k: int) -> bool:
    """Whether a character stands between two letters."""
    return 0 < k < len(run) - 1 and run[k - 1].isalpha() and run[k + 1].isalpha()


def restore(run: str, model: PairModel) -> tuple[str, str | None]:
    """The likeliest original of a run and the mapping used, or the run itself and None."""
    best, how = run, None
    for _ in range(3):
        wide = {c for c in best if c > "\x7f"}
        if not wide:
            break
        score, step = model.likelihood(best) + GAIN, None
        seen = {best}
        for name in READ_AS:
            leads, rest = _utf8_sets(name)
            if wide.isdisjoint(leads) or wide.isdisjoint(rest):
                continue
            made = _as_utf8(best, name)
            if made not in seen:
                seen.add(made)
                if (s := model.likelihood(made)) > score:
                    score, step, kept = s, f"utf-8 as {name}", made
        if step is None and how is None:
            for name, other in _likely_swaps(best, model):
                table = _swap(name, other)
                made = "".join(x if k % 2 else x.translate(table) for k, x in enumerate(_BREAK.split(best)))
                if made in seen or made.count(LOST) > best.count(LOST):
                    continue
                seen.add(made)
                pairs = [(x, y) for x, y in zip(best, made) if x != y]
                changed = len(pairs)
                # a printed sign or a capital is no damage, but a sign between two letters may be
                inner = {k for k, (x, y) in enumerate(zip(best, made)) if x != y and _SIGNS[ord(x)] and y.isalpha() and _inside(best, k)}
                if not inner and all(_SIGNS[ord(x)] or x.lower() == y.lower() for x, y in pairs) or any("\x80" <= c < "\xa0" for c in made) or _mixed(best, made):
                    continue
                # one Latin letter for another, as at the end of a cut line, takes more to believe
                single = changed == 1 and (bool(inner) or all(c.isalpha() and c < "\u0250" for c in pairs[0]))
                # signs that are printed between letters take most
                joins = all(x in _JOINS for x, _ in pairs)
                if (s := model.likelihood(made)) > max(score, score - GAIN + max(min(PER_CHAR * changed, SURE), 2 * PER_CHAR * single, SURE * joins)):
                    score, step, kept = s, f"{other} as {name}", made
        if step is None:
            break
        best, how = kept, step if how is None else f"{how}, twice"
    return best, how


def segments(places: np.ndarray, gains: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-scoring segments (all maximal ones) of a sequence with ``gains`` at ``places`` and -_BRIDGE between."""
    found: list[list[float]] = []  # left total, right total, begin, end
    total, last = 0.0, int(places[0])
    for p, g in zip(places.tolist(), gains.tolist()):
        total -= _BRIDGE * max(0, p - last - 1)
        item = [total, total + g, p, p]
        total += g
        last = p
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= item[0]:
                j -= 1
            if j < 0 or found[j][1] >= item[1]:
                found.append(item)
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            del found[j:]
    return [(int(x[2]), int(x[3])) for x in found]


_HYPHENS = np.zeros(0x110000, bool)
_HYPHENS[[0xAC, 0xAD, 0x2010]] = True


def _usual(codes: np.ndarray) -> np.ndarray:
    """Pairs that are rare but never damage: printed signs beside ASCII or a letter, unless they stand between two
    letters, and hyphens at the end of a line."""
    letter = letter_table()[codes]
    plain = (codes < 128) | letter
    sign, hyphen, feed = _SIGNS[codes], _HYPHENS[codes], (codes == 10) | (codes == 32)
    sign[1:-1] &= ~(letter[:-2] & letter[2:])
    end = np.append(hyphen[:-1] & feed[1:], False)
    return np.append((sign[:-1] & plain[1:]) | (plain[:-1] & sign[1:]) | end[:-1] | end[1:], False)


class Finder:
    """Finds and restores damaged runs of texts in batches; results of runs are remembered up to a fixed number."""

    def __init__(self, model: PairModel):
        self.model = model
        self.test = lru_cache(maxsize=200_000)(lambda run: restore(run, model))

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, int, str, str]]]:
        """Per text: (begin, end, restored, mapping) of each damaged run."""
        texts = [t or "" for t in texts]
        out: list[list[tuple[int, int, str, str]]] = [[] for _ in texts]
        ids, begins, codes = slots(texts)
        if len(ids) < 2:
            return out
        wide = codes > 127
        at = np.flatnonzero(wide[:-1] | wide[1:])
        score = self.model.mutual[ids[at] * SLOTS + ids[at + 1]]
        low = (score < THETA) & ~_usual(codes)[at]
        lost = (codes[at] == 0xFFFD) | (codes[at + 1] == 0xFFFD)
        between = np.isin(at, begins[1:] - 1)  # from a text's end to the next text
        low, lost = low & ~between, lost & ~between
        at, gain = at[low | lost], np.minimum(THETA - score[low | lost], 4.0)
        gain[lost[low | lost]] = 4.0
        # a text's first character, against a line feed or a space before it
        head = begins[:-1][np.diff(begins) > 1]
        head = head[wide[head] & ~_SIGNS[codes[head]]]
        score = np.maximum(self.model.mutual[10 * SLOTS + ids[head]], self.model.mutual[32 * SLOTS + ids[head]])
        head, score = head[score < THETA], score[score < THETA]
        at, gain = np.concatenate([head, at]), np.concatenate([np.minimum(THETA - score, 4.0), gain])
        order = np.argsort(at, kind="stable")
        at, gain = at[order], gain[order]
        cut = np.searchsorted(at, begins)
        for k in np.flatnonzero(np.diff(cut) > 0):
            places, text = at[cut[k] : cut[k + 1]] - begins[k], texts[k]
            runs: list[list[int]] = []
            for a, b in segments(places, gain[cut[k] : cut[k + 1]]):
                b = min(b + 1, len(text) - 1)
                while a > 0 and text[a - 1] not in " \n":
                    a -= 1
                while b < len(text) and text[b] not in " \n":
                    b += 1
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                elif a < b:
                    runs.append([a, b])
            for a, b in runs:
                run = text[a:b]
                made, how = self.test(run)
                if how or LOST in run:
                    out[k].append((a, b, made, how or "lost"))
        return out


_OUT = "damaged int, restorable boolean, mapping string, restored string"


def repair(texts: DataFrame, model: PairModel, keys: list[str]) -> DataFrame:
    """Rows of ``texts`` with damaged text only: ``keys``, the number of damaged runs, whether all characters came
    back, the mappings used and the restored text. Null and empty texts are never damaged."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Finder(shared.value)
        for pdf in slices(batches):
            rows = []
            for k, found in enumerate(find(pdf["text"].tolist())):
                if found:
                    text, last, parts = pdf["text"].iat[k], 0, []
                    for a, b, made, _ in found:
                        parts += [text[last:a], made]
                        last = b
                    made = "".join([*parts, text[last:]])
                    rows.append((k, len(found), LOST not in made, ", ".join(sorted({x[3] for x in found})), made))
            if rows:
                at, n, full, how, made = zip(*rows)
                yield pdf[keys].iloc[list(at)].assign(damaged=np.array(n, np.int32), restorable=full, mapping=how, restored=made)

    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, "text").mapInPandas(run, f"{kinds}, {_OUT}")


def records(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """Blocks and book titles as one table ``rec_table, book_id, seq, text``; titles have seq -1."""
    minus = F.lit(-1).cast("int")
    a = blocks.select(F.lit("blocks").alias("rec_table"), "book_id", F.col("seq").cast("int").alias("seq"), "text")
    return a.unionByName(books.select(F.lit("books").alias("rec_table"), F.col("id").alias("book_id"), minus.alias("seq"), F.col("title").alias("text")))


def damaged_records(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """Distinct damaged records with their restored text. Repeated rows count once; empty tables give no row."""
    every = records(blocks, books).where("text IS NOT NULL")
    return repair(every, pair_model(every), ["rec_table", "book_id", "seq"]).dropDuplicates(["rec_table", "book_id", "seq", "restored"])
