"""Text blocks out of book files."""

from __future__ import annotations

import html
import io
import posixpath
import re
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from itertools import accumulate
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.functions import text as T
from quire.sources.files import _local, metadata, package

LEAST_CHARS, PAGE_WORDS = 3, 10
#: Elements that hold no text, that part blocks, and that are headings.
SKIPPED = "script|style|head|noscript|svg|template"
PARTING = "p|div|h[1-6]|li|blockquote|td|th|dt|dd|pre|tr|br|hr|section|article|figcaption"
_SKIP = re.compile(rf"(?is)<({SKIPPED})\b[^>]*?(?<!/)>.*?(?:</\1\s*>|\Z)|<!--.*?-->|<[!?][^>]*>")
_PART = re.compile(rf"(?i)</?(?:{PARTING})\b[^>]*>")
_HEADING = re.compile(r"(?is)<(h[1-3])\b[^>]*>(.*?)</\1\s*>")
_TAG = re.compile(r"<[^>]*>")


def _bare(markup: str, gap: str = "") -> str:
    return " ".join(html.unescape(_TAG.sub(gap, markup)).split())


def html_blocks(markup: str) -> tuple[list[str], str | None]:
    """Blocks of a page in order, and its first heading. Inline markup joins, block markup parts; broken markup is read
    as far as it goes."""
    markup = _SKIP.sub(" ", markup)
    heading = next((t for m in _HEADING.finditer(markup) if (t := _bare(m[2], " "))), None)
    blocks = [t for part in _PART.split(markup) if len(t := _bare(part)) > LEAST_CHARS]
    return blocks, heading


def decode(raw: bytes) -> str:
    for name in ("utf-8", "utf-16"):
        try:
            return raw.decode(name)
        except UnicodeError:
            pass
    return raw.decode("latin-1")


def natural(name: str) -> list:
    return [(0, int(x), "") if x.isdigit() else (1, 0, x.lower()) for x in re.findall(r"\d+|\D+", name)]


def reading_order(z: zipfile.ZipFile) -> tuple[list[str], dict[str, str]]:
    """Names of a packed book's pages by its spine, or else in natural order; and its metadata."""
    names = set(z.namelist())
    opf, tree = package(z)
    order = []
    if tree is not None:
        items = {e.get("id"): e for e in tree.iter() if _local(e.tag) == "item"}
        for ref in (e.get("idref") for e in tree.iter() if _local(e.tag) == "itemref"):
            e = items.get(ref)
            if e is not None and re.search("html|xml", e.get("media-type", "")):
                order.append(posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(e.get("href", "")))))
    order = [n for n in order if n in names]
    return order or sorted((n for n in names if re.search(r"\.x?html?$", n, re.I)), key=natural), metadata(tree)


def numbered(chapters: list[tuple[int | None, str | None, list[str]]]) -> list[tuple]:
    """Block rows of chapters (number, title, paragraphs): numbered over the whole book, placed within their chapter as
    if it were joined by line feeds."""
    rows = []
    for number, title, parts in chapters:
        ends = list(accumulate((len(t) + 1 for t in parts), initial=0))
        rows += [(t, len(t.split()), number, title, None, at) for t, at in zip(parts, ends)]
    return [(seq, *row) for seq, row in enumerate(rows)]


def read_epub(raw: bytes) -> tuple[list[tuple], dict]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        order, meta = reading_order(z)
        pages = [html_blocks(z.read(name).decode("utf-8", "replace")) for name in order]
    return numbered([(k, heading, parts) for k, (parts, heading) in enumerate(pages)]), meta


def read_txt(raw: bytes) -> tuple[list[tuple], dict]:
    parts = [x for p in re.split(r"\n\s*\n", decode(raw)) if (x := " ".join(p.split()))]
    return numbered([(None, None, parts)]), {}


def read_html(raw: bytes) -> tuple[list[tuple], dict]:
    parts, heading = html_blocks(decode(raw))
    return numbered([(0, heading, parts)]), {"title": heading} if heading else {}


def read_pages(texts: list[str], ocr: Callable[[int], str] | None = None) -> list[tuple]:
    """One block per page of at least PAGE_WORDS words; pages without a text layer go through ``ocr`` if given."""
    out: list[tuple] = []
    for k, t in enumerate(texts, 1):
        clean = lambda x: " ".join(re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", x).split())
        t = clean(t)
        if len(t.split()) < PAGE_WORDS and ocr is not None:
            t = clean(ocr(k))
        if len(t.split()) >= PAGE_WORDS:
            out.append((len(out), t, len(t.split()), None, None, k, None))
    return out


def layered_pages(layer: str | None, pages: int, ocr: Callable[[int], str] | None = None) -> list[tuple]:
    """Block rows of a work of pictures: its hidden text layer (pages parted by form feeds) if that has PAGE_WORDS words
    a page on average, else what the recogniser makes of each page."""
    texts = (layer or "").split("\f")
    if sum(len(t.split()) for t in texts) >= PAGE_WORDS * max(1, pages):
        return read_pages((texts + [""] * pages)[:pages])
    return read_pages([""] * pages, ocr)


def converting_reader(command: list[str], ending: str, made: str = "epub", timeout: float = 240.0) -> Callable[[bytes], tuple[list[tuple], dict]]:
    """A reader that has a program turn the file into a format there is a reader for. ``command``: words with {0} for the
    file and {1} for what is to be made. A missing program, a failure or more than ``timeout`` seconds is an error."""

    def read(raw: bytes) -> tuple[list[tuple], dict]:
        with tempfile.TemporaryDirectory() as folder:  # the program's own files, gone when it ends
            source, target = f"{folder}/in.{ending}", f"{folder}/out.{made}"
            with open(source, "wb") as f:
                f.write(raw)
            subprocess.run([w.format(source, target) for w in command], check=True, capture_output=True, timeout=timeout)
            with open(target, "rb") as f:
                return READERS[made](f.read())

    return read


READERS: dict[str, Callable[[bytes], tuple[list[tuple], dict]]] = {"epub": read_epub, "txt": read_txt, "html": read_html, "fb2": read_html}
_OUT = "book_key string, status string, title string, author string, language string, error string, blocks array<struct<seq:int,text:string,word_count:int,chapter_idx:int,chapter_title:string,page:int,char_offset:int>>"


def extract(files: DataFrame, readers: dict[str, Callable[[bytes], tuple[list[tuple], dict]]] | None = None) -> DataFrame:
    """One row per file with its blocks and metadata. files: path, format, content. A format without a reader needs
    conversion; a reader's failure, or a file without text, is a failed row, never a failed job."""
    known = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, fmt, raw in zip(pdf["path"], pdf["format"], pdf["content"]):
                if fmt not in known:
                    rows.append((path, "needs_conversion", None, None, None, "no reader", None))
                    continue
                try:
                    blocks, meta = known[fmt](bytes(raw))
                    rows.append((path, "extracted" if blocks else "failed", meta.get("title"), meta.get("creator"), meta.get("language"), None if blocks else "no extractable text", blocks))
                except Exception as e:
                    rows.append((path, "failed", None, None, None, f"{type(e).__name__}: {e}", None))
            if rows:
                yield pd.DataFrame(rows, columns=["book_key", "status", "title", "author", "language", "error", "blocks"], dtype=object).assign(blocks=lambda d: [None if b is None else [dict(zip(_FIELDS, x)) for x in b] for b in d["blocks"]])

    return files.select("path", "format", "content").mapInPandas(run, _OUT)


_FIELDS = ("seq", "text", "word_count", "chapter_idx", "chapter_title", "page", "char_offset")


def blocks(extracted: DataFrame) -> DataFrame:
    return extracted.select("book_key", F.inline("blocks"))


def exploded_book(members: DataFrame) -> DataFrame:
    """Blocks of books that are folders of pages: a chapter per file in natural order, named by heading or file name.

    members: folder, path, position, content.
    """
    @F.pandas_udf("struct<parts:array<string>,heading:string>")
    def pages(raw: pd.Series) -> pd.DataFrame:
        made = [html_blocks(decode(bytes(x))) for x in raw]
        return pd.DataFrame({"parts": [m[0] for m in made], "heading": [m[1] for m in made]})

    from pyspark.sql import Window as W

    df = members.select("folder", "path", (F.col("position") - 1).alias("chapter_idx"), pages("content").alias("x"))
    rows = df.select("folder", "chapter_idx", F.coalesce("x.heading", T.stem(F.col("path"))).alias("chapter_title"), F.posexplode("x.parts").alias("k", "text"))
    chapter = W.partitionBy("folder", "chapter_idx").orderBy("k")
    book = W.partitionBy("folder").orderBy("chapter_idx", "k")
    offset = F.coalesce(F.sum(F.length("text") + 1).over(chapter.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return rows.select("folder", (F.row_number().over(book) - 1).alias("seq"), "text", T.count_words(F.col("text")).alias("word_count"), "chapter_idx", "chapter_title", offset.alias("char_offset"))


#: recogniser's language names by two-letter code.
OCR_LANGS = {"en": "eng", "fr": "fra", "es": "spa", "de": "deu", "it": "ita", "pt": "por", "pl": "pol", "la": "lat", "ru": "rus", "nl": "nld", "zh": "chi_sim", "ja": "jpn", "el": "ell", "cs": "ces", "qu": "que"}


def ocr_language(language, available: set[str]):
    """The recogniser's language of a work, English where its pack is missing."""
    usable = {k: v for k, v in OCR_LANGS.items() if v in available}
    if not usable:
        return F.lit("eng")
    table = F.create_map(*[F.lit(x) for k, v in usable.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, F.lower(language)), F.lit("eng"))


def recognise(queue: DataFrame, engine: Callable[[bytes, str], list[str]]) -> DataFrame:
    """Pages of works read by an injected engine from (content, language) to page texts. queue: id, lang, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, lang, raw in zip(pdf["id"], pdf["lang"], pdf["content"]):
                try:
                    rows = read_pages(engine(bytes(raw), lang))
                except Exception:
                    continue  # stays in the queue
                if rows:
                    yield pd.DataFrame([(i, s, t, w, p) for s, t, w, _, _, p, _ in rows], columns=["book_id", "seq", "text", "word_count", "page"]).astype({"seq": "int32", "word_count": "int32", "page": "int32"})

    return queue.select("id", "lang", "content").mapInPandas(run, "book_id long, seq int, text string, word_count int, page int")
