"""Overlapping sentence-aligned passages.

Sentences are gathered until a passage has TARGET words; the next one begins with the last whole sentences of at
most OVERLAP words. A passage never crosses a chapter. What a passage holds depends on all before it in the chapter, so each
run of a chapter's blocks is read in order, as a stream, with only the open passage in memory; the runs of a book are
read side by side. Only two things go over from run to run: the numbers, which are added up from the runs' counts, and
whether a run that makes a single short passage only repeats the passage before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.operators.ordered import chapter_runs, running
from quire.runtime import materialize
from quire.sources.sinks import append_vectors

TARGET, LARGEST, OVERLAP = 300, 450, 45
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
SCHEMA = "book_id long, seq int, text string, word_count int, chapter_idx int, chapter_title string, page_start int, page_end int, char_offset int"


class Stream:
    """The open passage of one run of a book and the last one given out."""

    def __init__(self, book: int, run: int):
        self.book, self.run, self.seq, self.last = book, run, 0, None
        self.open: list[tuple] = []  # (sentence, words, block)
        self.out: list[tuple] = []

    def _emit(self) -> None:
        text = " ".join(s for s, _, _ in self.open)
        first = self.open[0][2]
        pages = [b[3] for _, _, b in self.open if b[3] is not None]
        self.out.append((self.book, self.run, self.seq, text, sum(w for _, w, _ in self.open), first[1], first[2], min(pages, default=None), max(pages, default=None), first[4]))
        self.seq, self.last = self.seq + 1, text

    def _tail(self) -> list[tuple]:
        total, k = 0, len(self.open)
        while k and total + self.open[k - 1][1] <= OVERLAP:
            k -= 1
            total += self.open[k][1]
        return self.open[k:]

    def words(self) -> int:
        return sum(w for _, w, _ in self.open)

    def add(self, block: tuple) -> None:
        """block: (text, chapter_idx, chapter_title, page, char_offset)."""
        for s in _SENTENCE.split(block[0] or ""):
            s = s.strip()
            if not s:
                continue
            n = len(s.split())
            # a passage is complete only once another sentence follows, which its tail is for
            if self.full:
                self.open, self.full = self._tail(), False
            if self.open and self.words() + n > LARGEST:
                self._emit()
                self.open = self._tail()
                if self.words() + n > LARGEST:
                    self.open = []
            self.open.append((s, n, block))
            if self.words() >= TARGET:
                self._emit()
                self.full = True

    full = False

    def close(self) -> None:
        """End of a run: the rest is a passage unless the last one holds it already."""
        if self.open and not self.full:
            text = " ".join(s for s, _, _ in self.open)
            if self.last is None or text not in self.last:
                self._emit()
        self.open, self.full = [], False


_PARTS = "book_id long, run long, k int, text string, word_count int, chapter_idx int, chapter_title string, page_start int, page_end int, char_offset int, complete boolean"


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Passages of runs (PARTS) of blocks sorted by book, run and seq. ``complete`` is false for a run's only passage if it
    was closed by the run's end."""
    stream, seen = None, None
    names = [c.split()[0] for c in _PARTS.split(", ")]
    none = lambda x: None if x is None or x != x else x

    def frame(rows: list[tuple], ended: bool) -> pd.DataFrame:
        made = pd.DataFrame([(*r, not (ended and r[2] == 0 and len(rows) == 1)) for r in rows], columns=names)
        for c in ("chapter_idx", "page_start", "page_end", "char_offset"):
            made[c] = made[c].astype("Int32")
        made["chapter_title"] = made["chapter_title"].astype(object).where(made["chapter_title"].notna(), None)
        return made

    def finish(stream: Stream) -> Iterator[pd.DataFrame]:
        before = stream.seq
        stream.close()
        if stream.out:
            yield frame(stream.out, stream.seq > before)

    for pdf in batches:
        for b, r, s, ci, ct, p, o, t in zip(*(pdf[c] for c in ("book_id", "run", "seq", "chapter_idx", "chapter_title", "page", "char_offset", "text"))):
            if stream is None or (b, r) != (stream.book, stream.run):
                if stream is not None:
                    yield from finish(stream)
                stream, seen = Stream(b, r), None
            if s == seen:  # a repeated row
                continue
            seen = s
            ci, p, o = none(ci), none(p), none(o)
            stream.add((t, None if ci is None else int(ci), none(ct), None if p is None else int(p), None if o is None else int(o)))
        if stream is not None and len(stream.out) > 1000:
            yield frame(stream.out, False)
            stream.out = []
    if stream is not None:
        yield from finish(stream)


def _repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs whose only passage is held by the last passage kept before it. Rows: each run's last passage, sorted."""
    book, last = None, None
    for pdf in batches:
        gone = []
        for b, r, text, complete in zip(pdf["book_id"], pdf["run"], pdf["text"], pdf["complete"]):
            if b != book:
                book, last = b, None
            if not complete and last is not None and text in last:
                gone.append((b, r))
            else:
                last = text
        if gone:
            yield pd.DataFrame(gone, columns=["book_id", "run"])


def chunk(blocks: DataFrame) -> DataFrame:
    """Passages of all books (SCHEMA), numbered within each book.

    Rows without book_id or seq are left out; of rows with one key the first by text counts, in the chapter of the
    smallest number; null and empty texts add nothing; a sentence of more than LARGEST words is a passage by itself.
    """
    slim = blocks.where("book_id IS NOT NULL AND seq IS NOT NULL").select("book_id", F.col("seq").cast("int").alias("seq"), "chapter_idx", "chapter_title", "page", "char_offset", "text")
    # runs are found without the texts, which then move once
    runs = chapter_runs(slim.groupBy("book_id", "seq").agg(F.min("chapter_idx").alias("chapter_idx"))).select("book_id", "seq", "run")
    rows = slim.join(runs, ["book_id", "seq"]).repartition("book_id", "run").sortWithinPartitions("book_id", "run", "seq", "text")
    parts = materialize(rows.mapInPandas(_run, _PARTS))
    # only books with a run of one short passage can repeat one; of those only each run's last passage is looked at
    short = parts.where("NOT complete").select("book_id").distinct()
    ends = parts.join(short, "book_id", "left_semi").groupBy("book_id", "run").agg(F.max_by(F.struct("text", "complete"), "k").alias("x")).select("book_id", "run", "x.text", "x.complete")
    gone = ends.repartition("book_id").sortWithinPartitions("book_id", "run").mapInPandas(_repeated, "book_id long, run long")
    kept = parts.join(gone, ["book_id", "run"], "left_anti")
    counts = running(kept.groupBy("book_id", "run").agg(F.count("*").alias("n")), "book_id", "run", "n", "until")
    numbered = kept.join(counts, ["book_id", "run"]).withColumn("seq", (F.col("until") - F.col("n") + F.col("k")).cast("int"))
    return numbered.select(*[c.split()[0] for c in SCHEMA.split(", ")])


def unembedded(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Passages that have no vector yet."""
    return chunks.join(vectors.select(key), key, "left_anti")


def embed_missing(chunks: DataFrame, path: str, encode, key: str = "chunk_id", batch: int = 256) -> None:
    """Vectors of all passages that have none under ``path`` yet, appended there. A run that stops is taken up where it
    was, as only vectors that were written count; doing it again adds nothing."""
    spark = chunks.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        chunks = unembedded(chunks, spark.read.parquet(path), key)
    append_vectors(embed(chunks, encode, key, batch), path, key)


def embed(chunks: DataFrame, encode, key: str = "chunk_id", batch: int = 256) -> DataFrame:
    """``key, book_id, embedding``: vectors of unit length by an injected function from texts to a matrix."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                m = np.asarray(encode(part["text"].tolist()), np.float32)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({key: part[key].to_numpy(), "book_id": part["book_id"].to_numpy(), "embedding": list(m)})

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, "book_id", "text").mapInPandas(run, f"{key} {kind}, book_id long, embedding array<float>")
