"""Noise of scanned pages: words hyphenated across lines, misread characters, running heads, page numbers.

A page's outer lines are compared over its book: a running head comes back on other pages (in full, or in both its
halves, so that misread characters don't hide it) or begins like the book's title or author; a printed number keeps
its distance from the page's place in the book. What is left is joined over line and page ends and its unknown
words are edited by the character editor, which may only make known words.

Known words are counted over all blocks without line breaks, and are what edits may make. The LEXICON most frequent go to
every executor. Where there are more, the rest stays a table: of each unknown word all edits are taken down that a bitmap
of the rest (BITS, which misses none) lets through and that are better than the best in the lexicon, a join tells which
are known, and another brings the known words of the rest to the pages that ask for them. The editor is trained on at
most SAMPLE of the unknown words of scanned pages, drawn by hash. Each unknown word is then edited once, and comes back to
its pages by a join.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.llm.editor import Editor, train
from quire.llm.hashing import slices
from quire.operators.ordered import neighbour, running
from quire.runtime import discard, materialize

LEXICON, LEAST_COUNT, SAMPLE, EDGE, LONGEST_HEAD = 300_000, 2, 20_000, 2, 60
#: Of a page's longest line, what a line in a stack of heads doesn't reach; lines of the next page that are looked at for
#: its first words, beyond empty ones, and characters of each.
SHORT_LINE, NEXT_LINES, NEXT_CHARS = 0.6, 8, 100
#: Bits of the bitmap of known words beyond the lexicon.
BITS = 1 << 27
MARKS = "-\xad¬‐"
_MARK_SET = set(MARKS)
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W_]+(?:[!|][^\W_]+)*")
_BREAK = re.compile(rf"([^\W_]*[^\W\d_])([{MARKS}])[ \t]*$")
_PARTED = re.compile(rf"(?<=[^\W_])[{MARKS}][ \t]*\n\s*(?=[^\W_])")
#: A word with its line ends, in a text where _LINE_END stands for them.
_LINE_END = "\ue000"
_CHAIN = re.compile(rf"[^\W_]+(?:[!|{_LINE_END}][^\W_]+)*")
_START = re.compile(r"[«“„\"'(]*([^\W_]+)")
_NUMBER = re.compile(r"[\s\-–—\[\](){}.·*|]*(?:(?:p|s|pag|page|seite|стр|с)\.?\s*)?([0-9OoIl]{1,4}|[ivxlc]{1,8}|[IVXLC]{1,8})[\s\-–—\[\](){}.·*|]*", re.I)
#: A number set off from the rest of a running head by a gap.
_INSIDE = re.compile(r"^\W*([0-9OoIl]{1,4}|[ivxl]{1,7})\s{2,}\S|\S\s{2,}([0-9OoIl]{1,4}|[ivxl]{1,7})\W*$")
#: Chapter labels as running heads (with an Arabic number; a heading stands in capitals).
_LABEL = re.compile(r"(Ch.{0,2}pt.r|K.pit.l|Ch.{0,2}pitr.|C.pit.l.|C.p.tul.|Гл.в.)\s+\d{1,3}")
_HEADING = re.compile(r"[\W\d]*|[\W\d]*[IVXLC]+[\W\d]*|\w{3,10}\s+([IVXLC]{1,8}|\d{1,3})\.?")
#: Signs of wrong decoding inside a word, which is no scanner's error: other scripts and symbols, capitals with accents
#: after a small letter, Latin and Cyrillic letters in one word.
_FOREIGN = re.compile(r"[^\x00-\xff\u0152\u0153\u0178\u0400-\u04ff\u2010-\u2027]|[\x80-\xa0\xa2-\xaa\xae-\xba\xbc-\xbe]|[a-z][À-Þ]|[A-Za-zÀ-ÿ][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-zÀ-ÿ]")
#: Words of the languages here that would also be roman numbers.
_ROMAN_WORDS = ("vi", "li", "ci")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def roman(s: str) -> int | None:
    """The value of a well-formed roman number below 400, else None."""
    if not re.fullmatch(r"c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", s) or not s:
        return None
    values = [_ROMAN[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))


def printed_number(line: str) -> tuple[int, str] | None:
    """Value and style of a line that holds nothing but a printed number."""
    m = _NUMBER.fullmatch(line)
    if not m or re.search(r"\)\s*[.,;!?]|[.,]\s*$", line):
        return None
    return _value(m[1])


def _value(text: str) -> tuple[int, str] | None:
    if text.isdigit():
        return int(text), "d"
    if text.islower() and (v := roman(text)):
        return v, "r"
    if any(c.isdigit() for c in text):
        made = text.translate(str.maketrans("OoIl", "0011"))
        return (int(made), "d") if made.isdigit() else None
    return None


def fold(line: str) -> str:
    return "".join(filter(str.isalpha, line.lower()))


def edges(lines: list[str]) -> list[tuple[int, str, bool]]:
    """The outermost EDGE filled lines at either end, and further ones inwards as long as all before them are short or
    numbers, as in stacked heads: index, text, and whether an empty line separates it from the body."""
    filled = [k for k, x in enumerate(lines) if x.strip()]
    full = SHORT_LINE * max((len(lines[k]) for k in filled), default=0)

    def reach(order: list[int]) -> int:
        n = EDGE
        while n < len(order) // 2 and all(len(lines[k].strip()) < full for k in order[:n]):
            n += 1
        return n

    out = {}
    for k in filled[: reach(filled)]:
        out[k] = k + 1 < len(lines) and not lines[k + 1].strip()
    for k in filled[-reach(filled[::-1]) :]:
        out.setdefault(k, False)
    return [(k, lines[k].strip(), gap) for k, gap in sorted(out.items())]


def _keys(line: str) -> list[str]:
    f = fold(re.sub(r"\s\d+\s*$|^\s*\d+\s", " ", line))
    n = min(12, len(f) // 2)
    return [] if len(f) < 5 else [f"f{f}"] + ([f"p{f[:n]}", f"s{f[-n:]}"] if len(f) >= 10 else [])


def paged(blocks: DataFrame) -> DataFrame:
    """Distinct blocks that are pages: with a page number, or with line breaks kept."""
    pages = blocks.where("book_id IS NOT NULL AND seq IS NOT NULL AND text IS NOT NULL").where(F.col("page").isNotNull() | F.col("text").contains("\n"))
    return pages.select("book_id", F.col("seq").cast("int").alias("seq"), F.col("page").cast("int").alias("page"), "text")


_EDGE = "book_id long, seq int, page int, line int, kind string, key string, num int"


def _edge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in slices(batches):
        rows = []
        for b, s, p, t in zip(pdf["book_id"], pdf["seq"], pdf["page"], pdf["text"]):
            at = int(p) if p == p and p is not None else None
            lines = t.split("\n")
            n = len([x for x in lines if x.strip()])
            for k, line, _ in edges(lines):
                if number := printed_number(line):
                    place = number[0] - (at if at is not None else int(s))
                    rows.append((b, s, at, k, "n", f"{number[1]}{place}{'' if at is not None else '?'}", number[0]))
                elif n > 1:
                    if m := _INSIDE.search(line):
                        if number := _value(m[1] or m[2]):
                            rows.append((b, s, at, k, "i", f"{number[1]}{number[0] - (at if at is not None else int(s))}{'' if at is not None else '?'}", number[0]))
                    rows += [(b, s, at, k, "h", key, None) for key in _keys(line)]
        if rows:
            yield pd.DataFrame(rows, columns=["book_id", "seq", "page", "line", "kind", "key", "num"]).astype({"page": "Int32", "num": "Int32"})


def furniture_evidence(pages: DataFrame) -> DataFrame:
    """``book_id, seq, marks``: for each outer line its evidence as strings ``line:kind:key:count``, count being the
    number of pages of the book on which the same key stands in an outer line."""
    rows = materialize(pages.mapInPandas(_edge_rows, _EDGE).distinct())
    count = rows.groupBy("book_id", "kind", "key").agg(F.count_distinct("seq").alias("n"))
    seen = rows.join(count, ["book_id", "kind", "key"]).where("n > 1 OR kind = 'n'")
    mark = F.concat_ws(":", "line", "kind", "key", "n")
    made = materialize(seen.groupBy("book_id", "seq").agg(F.collect_list(mark).alias("marks")))
    discard(rows)
    return made


_folded = lru_cache(maxsize=50_000)(fold)


@lru_cache(maxsize=50_000)
def _trigrams(folded: str) -> frozenset[str]:
    return frozenset(folded[i : i + 3] for i in range(len(folded) - 2))


def _like_title(folded: str, title: str | None) -> bool:
    """Whether a line is the beginning of a title or name, or shares half its trigrams with one of about its length."""
    t = _folded(title or "")
    if len(t) < 6 or len(folded) < 6:
        return False
    if t.startswith(folded) or folded.startswith(t):
        return True
    if len(folded) < 8 or len(folded) > 1.3 * len(t) + 3:
        return False
    own = {folded[i : i + 3] for i in range(len(folded) - 2)}
    return len(own & _trigrams(t[: len(folded) + 8])) >= 0.5 * len(own)


def furniture(lines: list[str], marks: list[str], title: str | None, author: str | None) -> dict[int, set[str]]:
    """Kinds of furniture (header, page_number) by line. Position, repetition and likeness to title or author decide."""
    evidence: dict[tuple[int, str], int] = {}
    number: dict[int, tuple[str, int]] = {}
    for m in marks:
        line, kind, key, n = m.split(":")
        if kind == "h":
            evidence[int(line), key[0]] = int(n)
        else:
            number[int(line)] = (key, int(n))
    out: dict[int, set[str]] = {}
    filled = [k for k, x in enumerate(lines) if x.strip()]
    if not filled:
        return out
    for k, line, gap in edges(lines):
        if (got := printed_number(line)) is not None:
            key, n = number.get(k, ("", 0))
            fits = n > 1 or got[1] == "d" and (len(line) > len(str(got[0])) or got[0] < 1000) or got[1] == "r" and len(line) > 1 and line not in _ROMAN_WORDS
            if fits:
                out.setdefault(k, set()).add("page_number")
            continue
        f = fold(line)
        whole, first, last = (evidence.get((k, c), 0) for c in "fps")
        heading = gap and (line.isupper() or roman(line.lower().strip(".")) is not None) and k == filled[0]
        label = bool(_LABEL.fullmatch(line))
        repeated = whole >= 2 and len(f) >= 10 or whole >= 3 and len(f) >= 5 or len(line) <= LONGEST_HEAD and (first >= 2 and last >= 2 or (first >= 3 or last >= 3 and line[:1].isupper()) and not line.endswith((".", ",", ";", "!", "?")))
        if label or repeated and not heading or _like_title(f, title) or _like_title(f, author):
            out.setdefault(k, set()).add("header")
            if k in number or _INSIDE.search(line):
                out[k].add("page_number")
        elif k in number and number[k][1] > 2:  # a number in its place: the rest of the line is a head
            out.setdefault(k, set()).update(("header", "page_number"))
    # furniture lies outside: a line further in than a line of text is text
    for side in (filled, filled[::-1]):
        inside = False
        for k in side[: max(EDGE + 1, len(out) + 1)]:
            inside = inside or k not in out
            if inside and k in out and side is filled and filled.index(k) < len(filled) / 2:
                del out[k]
            elif inside and k in out and side is not filled and filled.index(k) >= len(filled) / 2:
                del out[k]
    return out


def word_counts(blocks: DataFrame) -> DataFrame:
    """``word, n``: the words (also hyphened ones) of blocks without line breaks that stand there LEAST_COUNT times."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                seen.update(_WORDS.findall(t.lower()))
            if len(seen) > 500_000:
                yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    clean = blocks.where(F.col("page").isNull() & F.col("text").isNotNull() & ~F.col("text").contains("\n")).select("text")
    return clean.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def lexicon(counts: DataFrame) -> dict[str, int]:
    """The LEXICON most frequent of ``word_counts``, with their counts; the parts of hyphened words are words too."""
    rows = counts.orderBy(F.col("n").desc(), "word").limit(LEXICON).toPandas()
    known = dict(zip(rows["word"], rows["n"].astype(int)))
    for w, n in list(known.items()):
        for part in w.split("-") if "-" in w else ():
            known[part] = known.get(part, 0) + n
    return known


def line_words(text: str) -> set[str]:
    """The words that decide on a page's line ends (both halves, joined and hyphened), and those that stand there if some
    of successive line ends are joined and others aren't."""
    lines = text.split("\n")
    words: set[str] = set()
    for line, after in zip(lines, lines[1:]):
        if (m := _BREAK.search(line)) and (n := _START.match(after.lstrip())):
            a, b = m[1].lower(), n[1].lower()
            words.update((a, b, a + b, f"{a}-{b}"))
    for word in _CHAIN.findall(_PARTED.sub(_LINE_END, text.lower())):
        parts = word.split(_LINE_END)
        if len(parts) > 2:
            words.update("".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 2, len(parts) + 1))
    return words


def page_edges(text: str, head: str) -> tuple[list[str], list[str]]:
    """First halves of words at line ends that may be the page's last, and first words of lines that may be its first."""
    lines = text.split("\n")
    outer = {k for k, _, _ in edges(lines)}
    tails, starts = set(), {n[1].lower() for x in head.split("\n") if (n := _START.match(x.lstrip()))}
    for k in range(len(lines) - 1, -1, -1):
        if lines[k].strip():
            if m := _BREAK.search(lines[k]):
                tails.add(m[1].lower())
            if k not in outer:
                break
    return sorted(tails), sorted(starts)


def unknown_words(pages: DataFrame, known, ends: bool = False) -> DataFrame:
    """``book_id, seq, word``: of each page the distinct words that aren't in the lexicon, also those that are parted at a
    line's end; with ``ends`` all that are asked for at line ends, whatever is joined there."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            rows = []
            for b, s, text in zip(pdf["book_id"], pdf["seq"], pdf["text"]):
                t = text.lower()
                words = set(_TOKEN.findall(t))
                if (whole := _PARTED.sub("", t)) != t:
                    words.update(_TOKEN.findall(whole))
                if ends:
                    words |= line_words(text)
                rows += [(b, s, w) for w in words if w not in known.value and not w.isdigit()]
            if rows:
                yield pd.DataFrame(rows, columns=["book_id", "seq", "word"])

    return pages.select("book_id", "seq", "text").mapInPandas(find, "book_id long, seq int, word string")


def words_between_pages(pages: DataFrame, known) -> DataFrame:
    """``book_id, seq, word``: the words outside the lexicon that are asked for where a page may end in half a word."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            rows = [(b, s, *page_edges(t, h)) for b, s, t, h in zip(pdf["book_id"], pdf["seq"], pdf["text"], pdf["head"])]
            if rows:
                yield pd.DataFrame(rows, columns=["book_id", "seq", "tails", "starts"])

    def outside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[w not in known.value and not w.isdigit() for w in pdf["word"]]]

    light = pages.select("book_id", "seq", "text", _head().alias("head")).mapInPandas(find, "book_id long, seq int, tails array<string>, starts array<string>")
    light = light.groupBy("book_id", "seq").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("tails", "starts")])
    near = neighbour(light, "book_id", "seq", ["starts"], "_next", forward=True).where(F.size("tails") > 0)
    both = near.select("book_id", "seq", F.explode("tails").alias("a"), F.col("_next.starts").alias("starts")).select("book_id", "seq", "a", F.explode("starts").alias("b"))
    words = both.select("book_id", "seq", F.explode(F.array("a", "b", F.concat("a", "b"), F.concat("a", F.lit("-"), "b"))).alias("word"))
    return words.distinct().mapInPandas(outside, "book_id long, seq int, word string")


def _slots(word: str, size: int) -> Iterator[int]:
    """The bits of a word; the first is quickly had, and mostly shows that a word isn't there."""
    code = word.encode("utf-8", "surrogatepass")
    yield zlib.crc32(code) % size
    h = int.from_bytes(hashlib.blake2b(code, digest_size=12).digest(), "little")
    yield from (h % size, (h >> 32) % size, (h >> 64) % size)


def bitmap(words: DataFrame, size: int) -> bytes:
    """``size`` bits, of which each word has set four."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size // 8, np.uint8)
        for pdf in batches:
            at = np.array([[*_slots(w, size)] for w in pdf["word"]], np.int64).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pd.DataFrame({"bits": [bits.tobytes()]})

    total = np.zeros(size // 8, np.uint8)
    for row in words.select("word").coalesce(4).mapInPandas(fill, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return total.tobytes()


def edited_words(words: DataFrame, weights, known, rest: DataFrame | None = None) -> DataFrame:
    """``word, fix`` of the words that the editor makes known ones of. Each word is edited once, whoever has it. ``rest``: the
    words known beyond the lexicon, as a stored table, if there are any."""
    size = BITS
    bits = None if rest is None else words.sparkSession.sparkContext.broadcast(bitmap(rest, size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor = Editor(weights.value, known.value)
        maybe = None if bits is None else lambda w, has=bits.value: all(has[x >> 3] >> (x & 7) & 1 for x in _slots(w, size))
        for pdf in batches:
            rows = [(w, at, made, sure) for w in pdf["word"] for at, (made, sure) in enumerate(editor.candidates(w, maybe))]
            if rows:
                yield pd.DataFrame(rows, columns=["word", "at", "fix", "sure"])

    made = words.mapInPandas(run, "word string, at int, fix string, sure boolean")
    if rest is None:
        return made.select("word", "fix")
    made = materialize(made, free=False)
    real = made.where("NOT sure").join(rest.select(F.col("word").alias("fix")), "fix", "left_semi").select(*made.columns)
    return made.where("sure").unionByName(real).groupBy("word").agg(F.min_by("fix", "at").alias("fix"))


class Cleaner:
    def __init__(self, weights, known: dict[str, int]):
        self.known, self.editor = known, Editor(weights, known)
        #: Words of the page in hand that were looked at before: what is made of them (of words known beyond the lexicon,
        #: themselves), or None.
        self.seen: dict[str, str | None] = {}

    def _fix(self, word: str) -> str | None:
        if word in self.known or word.isdigit():
            return None
        if word not in self.seen:
            return self.editor.edit(word)
        return made if (made := self.seen[word]) != word else None

    def _joins(self, first: str, mark: str, second: str) -> bool:
        a, b = first.lower(), second.lower()
        known = {w for w in (a, b, a + b, f"{a}-{b}") if w in self.known or self.seen.get(w) == w}
        return self.editor.joins(first, mark, second, known)

    def _suspect(self, paragraph: str) -> set[str]:
        """The unknown words that can be edited: most paragraphs have none and need no second look."""
        return {w for w in set(_TOKEN.findall(paragraph.lower())) if self._fix(w)}

    def page(self, text: str, marks: list[str], title: str | None, author: str | None, following: Callable[[], str | None]) -> tuple[set[str], list[str], str, str]:
        """Kinds of noise, misread words with their correction, the cleaned text, and its last half word if the page
        ends in one. ``following`` gives the next page's first line of text."""
        lines = text.split("\n")
        out = furniture(lines, marks, title, author)
        kinds = set().union(*out.values()) if out else set()
        body = [x for k, x in enumerate(lines) if k not in out]
        while body and not body[-1].strip():
            body.pop()
        while body and not body[0].strip():
            body.pop(0)
        joined: list[str] = []
        tail = ""
        for k, line in enumerate(body):
            m = _BREAK.search(line) if line.rstrip(" \t")[-1:] in _MARK_SET else None
            after = None if not m else body[k + 1] if k + 1 < len(body) else following()
            if m and after:
                n = _START.match(after.lstrip())
                if n and (m[2] != "-" or n[1][:1].islower() or m[1].isupper()):
                    if self._joins(m[1], m[2], n[1]):
                        kinds.add("hyphenation")
                        if k + 1 == len(body):
                            tail = m[1]
                        joined.append(line[: m.start(2)] + "\0")
                        continue
                joined.append(line.rstrip() + "\0" if m[2] == "-" and k + 1 < len(body) else line)
                continue
            if m and m[2] != "-":
                kinds.add("hyphenation")
                tail = m[1]
                joined.append(line[: m.start(2)] + "\0")
                continue
            joined.append(line)
        # joined lines run on, empty lines part paragraphs, other line ends are spaces
        whole = "\n".join(x.rstrip() if not x.endswith("\0") else x for x in joined).replace("\0\n", "").rstrip("\0")
        whole = re.sub(r"[ \t]*\n[ \t]*(?!\n)(?<!\n\n)", "\n", whole)
        paragraphs = [re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n\s*\n", whole)]
        fixes: list[str] = []
        bad: set[str] = set()

        def fix(m: re.Match) -> str:
            word = m[0]
            low = word.lower()
            if low not in bad or _FOREIGN.search(word) or _FOREIGN.search(m.string[m.end() : m.end() + 1]) or tail and m.end() == len(m.string):
                return word
            made = self._fix(low)
            if made is None or made == low:
                return word
            fixes.append(f"{word}>{made}")
            return made.upper() if word.isupper() and len(word) > 1 else made.capitalize() if word[:1].isupper() else made

        for k, p in enumerate(paragraphs):
            if (bad := self._suspect(p)) and not _HEADING.fullmatch(p):
                paragraphs[k] = _TOKEN.sub(fix, p)
        paragraphs = [p for p in paragraphs if p]
        if fixes:
            kinds.add("misread")
        return kinds, fixes, "\n\n".join(paragraphs), tail


def _head() -> F.Column:
    """The first lines of a page's text, which may hold its first words."""
    first = F.regexp_extract("text", rf"^(?:[^\n]*\n\s*){{0,{NEXT_LINES}}}[^\n]*", 0)
    return F.array_join(F.transform(F.split(first, "\n"), lambda x: F.substring(x, 1, NEXT_CHARS)), "\n")


def clean(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """One row per page: ``book_id, seq, kinds, fixes, body`` (cleaned text, paragraphs parted by empty lines) and
    ``open`` (whether the body ends in the first half of a word).

    Blocks that are no pages are left out; a null text is no page; repeated rows count once (of rows that disagree
    under one key, the first text by code point); a page without text has no noise.
    """
    spark = blocks.sparkSession
    pages = paged(blocks)
    counts = materialize(word_counts(blocks), free=False)
    known = spark.sparkContext.broadcast(lexicon(counts))
    rest = None
    more = counts.count() > LEXICON
    unknown = unknown_words(pages, known, ends=more)
    if more:  # words beyond the lexicon are known all the same
        rest = counts.select(F.explode(F.array_union(F.array("word"), F.split("word", "-"))).alias("word")).distinct()
        rest = materialize(rest, free=False)
        unknown = unknown.unionByName(words_between_pages(pages, known)).distinct()
    unknown = materialize(unknown, free=False)
    words = unknown.select("word").distinct()
    if rest is not None:
        words = words.where(~F.col("word").contains("-")).join(rest, "word", "left_anti")
    words = materialize(words, free=False)
    sample = [r.word for r in words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
    weights = spark.sparkContext.broadcast(train(sample, known.value))
    fixes = edited_words(words.repartition(2 * spark.sparkContext.defaultParallelism), weights, known, rest)
    if rest is not None:
        fixes = fixes.unionByName(unknown.select("word").distinct().join(rest, "word", "left_semi").select("word", F.col("word").alias("fix")))
    seen = unknown.join(fixes, "word", "left").groupBy("book_id", "seq").agg(F.map_from_entries(F.collect_set(F.struct("word", "fix"))).alias("seen"))
    evidence = furniture_evidence(pages)
    names = books.select(F.col("id").alias("book_id"), "title", "author").dropDuplicates(["book_id"])
    each = pages.groupBy("book_id", "seq").agg(F.min("text").alias("text")).join(evidence, ["book_id", "seq"], "left")
    each = materialize(each.join(seen, ["book_id", "seq"], "left"))
    discard(counts, unknown, words, *([] if rest is None else [rest]))
    # the next page's first words that aren't furniture are needed at a page's end: its first lines go along
    rows = neighbour(each.withColumn("head", _head()), "book_id", "seq", ["head", "marks"], "_next", forward=True, along=names)
    rows = rows.select("book_id", "seq", "text", "marks", "title", "author", "seen", F.col("_next.head").alias("next_head"), F.col("_next.marks").alias("next_marks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cleaner = Cleaner(weights.value, known.value)
        for pdf in slices(batches):
            out = []
            for b, s, text, marks, title, author, seen, head, next_marks in zip(*(pdf[c] for c in ("book_id", "seq", "text", "marks", "title", "author", "seen", "next_head", "next_marks"))):
                cleaner.seen = dict(seen) if seen is not None else {}
                marks = list(marks) if marks is not None else []

                def following(head=head, marks=next_marks, title=title, author=author) -> str | None:
                    if not isinstance(head, str):
                        return None
                    lines = head.split("\n")
                    cut = furniture(lines + ["-"] * 8, list(marks) if marks is not None else [], title, author)
                    return next((x for k, x in enumerate(lines) if k not in cut and x.strip()), None)

                kinds, fixes, body, tail = cleaner.page(text, marks, title, author, following)
                out.append((b, s, sorted(kinds), fixes, body, bool(tail)))
            yield pd.DataFrame(out, columns=["book_id", "seq", "kinds", "fixes", "body", "open"])

    return rows.mapInPandas(run, "book_id long, seq int, kinds array<string>, fixes array<string>, body string, open boolean")


def noise(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """``book_id, seq, noise``: one row per page and kind of noise."""
    return clean(blocks, books).select("book_id", "seq", F.explode("kinds").alias("noise"))


def paragraphs(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """``book_id, paragraph, text``: continuous paragraphs of each book of pages, in order. A paragraph that a page
    leaves unfinished goes on with the next page's first one."""
    pages = clean(blocks, books).select("book_id", "seq", "open", F.split("body", "\n\n").alias("parts"))
    pages = materialize(pages.where(F.length(F.array_join("parts", "")) > 0))
    last = F.element_at("parts", -1)
    ends = F.col("open") | ~last.rlike("[.!?…:»”\"')\\]*]$") & ~(F.upper(last) == last)
    light = pages.select("book_id", "seq", F.size("parts").alias("n"), ends.alias("unfinished"))
    light = neighbour(light, "book_id", "seq", ["unfinished"], "_last").withColumn("more", F.col("n") - F.coalesce("_last.unfinished", F.lit(False)).cast("int")).drop("_last")
    start = running(light, "book_id", "seq", "more", "until").withColumn("start", F.col("until") - F.col("n"))
    rows = pages.join(start.select("book_id", "seq", "start"), ["book_id", "seq"]).select("book_id", "seq", "open", F.size("parts").alias("n"), "start", F.posexplode("parts").alias("k", "part"))
    glue = F.when(F.col("open") & (F.col("k") == F.col("n") - 1), F.lit("")).otherwise(F.lit(" "))
    piece = F.struct("seq", F.concat("part", glue).alias("t"))
    joined = rows.groupBy("book_id", (F.col("start") + F.col("k")).alias("paragraph")).agg(F.sort_array(F.collect_list(piece)).alias("x"))
    return joined.select("book_id", "paragraph", F.trim(F.array_join("x.t", "")).alias("text"))
