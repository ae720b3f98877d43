"""Text functions on columns: cleaning, counting, splitting, normalising, scoring. All stay inside the JVM.

Null in, null out, unless a docstring says otherwise. White space is Unicode white space, spelt out because regular
expression engines differ on what ``\\s`` holds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, functions as F

#: The characters Python's str.split() parts words at.
SPACE = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
#: What doesn't count in a title: bracketed parts and these signs.
TITLE_NOISE = r"[(\[{].*?[)\]}]|[-_.,;:!?'\"]+"
#: Limits of the quality score, the excerpt and the title.
EXCERPT_CHARS, TITLE_CHARS = 400, 200


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda an outer expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_ws(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, SPACE + "+", " "), "^ | $", "")


def clean_page_text(text: Column) -> Column:
    """Joins words hyphenated over a line end, then normalises white space."""
    return normalize_ws(F.regexp_replace(text, rf"({WORD})-{SPACE}*\n{SPACE}*({WORD})", "$1$2"))


def split_paragraphs(text: Column) -> Column:
    """Paragraphs parted by empty lines, white space normalised, empty ones dropped."""
    return F.filter(F.transform(F.split(text, rf"\n{SPACE}*\n"), normalize_ws), lambda p: p != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Pieces between white space; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def quality_score(text: Column) -> Column:
    """Share of characters that belong in prose; 0 for null and empty."""
    bad = F.length(F.regexp_replace(text, r"[\p{L}\p{N}_ .,;:!?()'\"\-–—\t\n\r\f\x{000B}]", ""))
    return F.when(F.length(text) > 0, 1 - bad / F.length(text)).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    """Pieces between white space after a sentence's last sign, trimmed, empty ones dropped."""
    marked = F.regexp_replace(text, rf"([.!?…]){SPACE}+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", "")), lambda s: s != "")


def strip_html(html: Column) -> Column:
    """Text of a page without scripts, styles and tags; the five named entities and nbsp are resolved."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style\b.*?</style>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return normalize_ws(text)


def norm_lang(label: Column) -> Column:
    """Lower case, cut at the first - or _; null for nothing."""
    head = F.split(F.split(F.lower(F.trim(label)), "-")[0], "_")[0]
    return F.when(head != "", head)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    """The folder of a path; . where there is none."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(F.instr(path, "/") > 0, found).otherwise(F.when(path.isNotNull(), F.lit(".")))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]*)$", 1))


def title_from_filename(path: Column) -> Column:
    """The stem with dots and underscores as spaces, at most TITLE_CHARS long."""
    return F.substring(normalize_ws(F.regexp_replace(stem(path), "[_.]+", " ")), 1, TITLE_CHARS)


def title_key(title: Column) -> Column:
    """Lower case without bracketed parts and punctuation: the same for editions of one work."""
    return normalize_ws(F.regexp_replace(F.lower(title), TITLE_NOISE, " "))


def query_tokens(text: Column) -> Column:
    """Words of a query in lower case, with repetitions."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))


def shingle_tokens(text: Column) -> Column:
    """Words made of letters only, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct windows of ``size`` letter words, joined by spaces; empty for shorter texts."""
    none = F.array().cast("array<string>")
    every = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (size - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(size)), " "))
    return bind(shingle_tokens(text), lambda t: F.when(F.size(t) >= size, F.array_distinct(every(t))).otherwise(none))


def _fold_table() -> tuple[str, str]:
    """Letters whose decomposition is one plain letter and marks, and those plain letters."""
    a, b = [], []
    for code in range(0xC0, 0x1F00):
        parts = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(code):
            a.append(chr(code))
            b.append(parts[0])
    return "".join(a), "".join(b)


_ACCENTED, _PLAIN = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"\p{Mn}", "")


def index_tokens(text: Column) -> Column:
    """Tokens of the lexical index: runs of letters and digits, folded. Plain tokens are left as they are."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{Mn}]+"), F.lit(0))
    folded = F.transform(tokens, lambda t: F.when(t.rlike("[^a-z0-9]"), fold(t)).otherwise(t))
    return F.filter(folded, lambda t: t != "")


def norm_match(text: Column) -> Column:
    """Lower case with single spaces; empty for null."""
    return F.lower(normalize_ws(F.coalesce(text, F.lit(""))))


def excerpt(text: Column, chars: int = EXCERPT_CHARS) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def block_locator(page: Column, chapter_idx: Column, chapter_title: Column) -> Column:
    """Page of fixed-layout text, else the chapter's title or number, else text."""
    chapter = F.when(chapter_idx.isNotNull(), F.coalesce(chapter_title, F.concat(F.lit("chapter "), (chapter_idx + 1).cast("string"))))
    return F.coalesce(F.concat(F.lit("p. "), page.cast("string")), chapter, F.lit("text"))


def passage_locator(first: Column, last: Column, chapter_idx: Column, chapter_title: Column) -> Column:
    """Page or range of pages (with an en dash), else the chapter's title or number, else text."""
    one = F.concat(F.lit("p. "), first.cast("string"))
    pages = F.when(last.isNull() | (last == first), one).otherwise(F.concat(F.lit("pp. "), first.cast("string"), F.lit("–"), last.cast("string")))
    chapter = F.coalesce(chapter_title, F.concat(F.lit("chapter "), (chapter_idx + 1).cast("string")))
    return F.coalesce(pages, chapter, F.lit("text"))


def highlight(text: Column, query: Column) -> Column:
    """Escaped text with every whole word that is in the query inside <mark>."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_]+"), F.lit(0))
    escape = lambda p: F.replace(F.replace(F.replace(F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&#34;")), F.lit("'"), F.lit("&#39;"))
    marked = lambda asked: F.transform(pieces, lambda p: F.when(F.array_contains(asked, F.lower(p)), F.concat(F.lit("<mark>"), escape(p), F.lit("</mark>"))).otherwise(escape(p)))
    return F.array_join(bind(F.coalesce(query_tokens(query), F.array().cast("array<string>")), marked), "")


@lru_cache(maxsize=1)
def _composed() -> dict[str, str]:
    """Composed letters by their full decomposition."""
    every = ((c, unicodedata.normalize("NFD", c)) for c in map(chr, (*range(0xC0, 0x1200), *range(0x1E00, 0x2000))))
    return {d: c for c, d in every if d != c and unicodedata.normalize("NFC", d) == c and unicodedata.combining(d[-1])}


def compose(text: Column) -> Column:
    """Letters with combining marks as single characters (NFC), where there is one; marks in another order than the
    canonical one stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in _composed().items() for x in pair])
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\P{Mn}\p{Mn}*|\p{Mn}+"), F.lit(0))
    made = bind(table, lambda known: F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) > 1, F.coalesce(F.try_element_at(known, p), p)).otherwise(p)), ""))
    return F.when(text.rlike(r"\p{Mn}"), made).otherwise(text)


def ocr_normalize(text: Column) -> Column:
    """Composed letters, plain quotes and dashes, single spaces."""
    text = compose(text)
    return normalize_ws(F.translate(text, "„“”‚‘’—–", "\"\"\"'''--"))


def cer(read: Column, truth: Column) -> Column:
    """Edits over the length of the true text."""
    return F.levenshtein(read, truth) / F.greatest(F.length(truth), F.lit(1))


def garbage_ratio(text: Column) -> Column:
    """Share of characters no printed page has; null for nothing."""
    good = r"[A-Za-zÀ-ÿĀ-ž0-9\s.,;:!?()\[\]\-'\"„“”‚‘’«»&/%§+*=°_—–]"
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, good, "")) / F.length(text))


#: How titles begin that an export left behind.
JUNK_TITLES = r"(?i)^(microsoft (word|powerpoint)|dokument\d*|document\d*|doc\d+|untitled|unbenannt|new document|scan\d*|print|acrobat|slide ?1|präsentation\d*)\b"


def pick_title(*titles: Column, path: Column) -> Column:
    """The first title that says something, else the one the file's name gives."""
    fit = [F.when((F.length(t) > 0) & ~F.trim(t).rlike(JUNK_TITLES), t) for t in titles]
    return F.coalesce(*fit, title_from_filename(path))


def natural_key(name: Column) -> Column:
    """A key that sorts numbers in names by value: every run of digits is padded to 20."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def humanize_hours(hours: Column) -> Column:
    return F.when(hours < 1, F.format_string("%.0f min", hours * 60)).when(hours < 48, F.format_string("%.1f h", hours)).otherwise(F.format_string("%.1f days", hours / 24))
