"""The catalog of works as snapshots: listings, queues, merges and replacements by anti-join and union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quire.functions import text as T


def upsert(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Both tables as one, of each key the row with the greatest ``order`` (rows of ``new`` win ties).

    Columns that only one side has are null on the other; rows without a key are kept as they are.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.col("_new").desc())
    keyed = both.where(F.col(key).isNotNull()).withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")
    return keyed.unionByName(both.where(F.col(key).isNull())).drop("_new")


def changed_files(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``found`` that aren't stored with the same path, size, time and probe version."""
    return found.join(stored.select("path", "size", "mtime_ns", "probe_version").distinct(), ["path", "size", "mtime_ns", "probe_version"], "left_anti")


def listing(books: DataFrame, book_files: DataFrame, status: str | None = None, search: str | None = None) -> DataFrame:
    """Works with the number of their files, optionally by status and by a part of title or author, which is a pattern
    with % and _ (any case)."""
    out = books
    if status is not None:
        out = out.where(F.col("status") == status)
    if search is not None:
        pattern = "%" + search.lower().replace("\\", "\\\\") + "%"
        like = lambda c: F.lower(F.coalesce(c, F.lit(""))).like(pattern)
        out = out.where(like("title") | like("author"))
    counts = book_files.dropDuplicates(["sha256"]).groupBy("book_id").agg(F.count("sha256").alias("files"))
    return out.join(counts, out["id"] == counts["book_id"], "left").select("id", "title", "author", "status", F.coalesce("files", F.lit(0)).alias("files"))


def primary_paths(book_files: DataFrame) -> DataFrame:
    """The first primary path of each work."""
    return book_files.where("role = 'primary'").groupBy("book_id").agg(F.min("path").alias("path"))


def awaiting(books: DataFrame, book_files: DataFrame, status: str = "awaiting_ocr", limit: int | None = None) -> DataFrame:
    """Works in a status with the path of their primary file; with a limit the first ones by id."""
    queue = books.where(F.col("status") == status).select("id", "language")
    if limit is not None:
        having = book_files.where("role = 'primary'").select(F.col("book_id").alias("id"))
        queue = queue.join(having, "id", "left_semi").orderBy("id").limit(limit)
    return queue.join(primary_paths(book_files), F.col("id") == F.col("book_id")).select("id", "language", "path")


def without_blocks(books: DataFrame, blocks: DataFrame) -> DataFrame:
    """Works that should have text and don't."""
    return books.where("block_count > 0").join(blocks.select(F.col("book_id").alias("id")), "id", "left_anti").select("id", "block_count")


def text_counts(blocks: DataFrame) -> DataFrame:
    """Words and blocks by work; repeated rows count once."""
    return blocks.dropDuplicates(["book_id", "seq"]).groupBy("book_id").agg(F.sum("word_count").alias("words"), F.count("*").alias("blocks"))


def totals(books: DataFrame) -> DataFrame:
    return books.agg(F.count("*").alias("books"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def outcomes(books: DataFrame) -> DataFrame:
    return books.groupBy("status").agg(F.count("*").alias("books"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.coalesce(F.sum("block_count"), F.lit(0)).alias("blocks"))


def merge_books(books: DataFrame, book_files: DataFrame, blocks: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after alternates were merged into their canonical works. merges: canonical, alternate.

    Files of an alternate move to the canonical work as alternate formats (duplicates stay duplicates); its record
    and its blocks go. An alternate of several merges goes to the smallest canonical.
    """
    to = merges.groupBy(F.col("alternate").alias("book_id")).agg(F.min("canonical").alias("canonical"))
    files = book_files.join(to, "book_id", "left")
    moved = F.col("canonical").isNotNull() & ~F.col("role").eqNullSafe(F.lit("duplicate"))
    files = files.withColumn("role", F.when(moved, "alternate_format").otherwise(F.col("role"))).withColumn("book_id", F.coalesce("canonical", "book_id")).drop("canonical").select(*book_files.columns)
    gone = to.select("book_id")
    return books.join(gone, books["id"] == gone["book_id"], "left_anti"), files, blocks.join(gone, "book_id", "left_anti")


def replace_blocks(books: DataFrame, blocks: DataFrame, read: DataFrame, languages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works and blocks after recognition: blocks of the works in ``read`` are replaced, their status becomes extracted
    and their language the recognised one if there is one. Doing it twice changes nothing."""
    done = read.select("book_id").distinct()
    new_blocks = blocks.join(done, "book_id", "left_anti").unionByName(read)
    counts = read.groupBy("book_id").agg(F.sum("word_count").alias("_w"), F.count("*").alias("_b"))
    df = books.join(counts, books["id"] == counts["book_id"], "left").drop("book_id").join(languages.select(F.col("book_id").alias("id"), F.col("language").alias("_l")), "id", "left")
    hit = F.col("_b").isNotNull()
    made = {"status": F.when(hit, "extracted").otherwise(F.col("status")), "language": F.coalesce(F.when(hit, F.col("_l")), "language"), "word_count": F.when(hit, F.col("_w")).otherwise(F.col("word_count")), "block_count": F.when(hit, F.col("_b")).otherwise(F.col("block_count"))}
    return df.withColumns(made).select(*books.columns), new_blocks


def retryable(books: DataFrame, book_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works waiting for a converter that may be tried again (their files are no chm), and all others."""
    chm = book_files.where(F.lower("path").endswith(".chm")).select("book_id")
    again = books.where("status = 'needs_conversion'").join(chm, books["id"] == chm["book_id"], "left_anti")
    return again, books.join(again.select("id"), "id", "left_anti")


def finalize(works: DataFrame, blocks: DataFrame, detected: DataFrame | None = None, chars: int = 12_000, least: float = 0.85) -> DataFrame:
    """Works (book_id, title, author, language, path; survey_title, survey_author, survey_language) with their final
    ``title, author, language, quality``.

    Quality is scored on the first ``chars`` characters of the work's blocks, joined by spaces. The detected language
    (book_id, lang, confidence) counts from ``least`` on, then the extracted one, then the survey's.
    """
    w = W.partitionBy("book_id").orderBy("seq")
    slim = blocks.where("book_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["book_id", "seq"]).select("book_id", "seq", "text")
    # blocks that begin within the sample: few of each work, however long it is
    begins = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = slim.withColumn("_at", begins).where(F.col("_at") < chars).groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("x"))
    scored = parts.select("book_id", F.round(T.quality_score(F.substring(F.array_join("x.text", " "), 1, chars)), 3).alias("quality"))
    out = works.join(scored, "book_id", "left")
    if detected is not None:
        out = out.join(detected.select("book_id", F.when(F.col("confidence") >= least, F.col("lang")).alias("_lang")), "book_id", "left")
    else:
        out = out.withColumn("_lang", F.lit(None).cast("string"))
    return out.select("book_id", T.pick_title(F.col("title"), F.col("survey_title"), path=F.col("path")).alias("title"), F.coalesce("author", "survey_author").alias("author"), F.coalesce("_lang", "language", "survey_language").alias("language"), F.coalesce("quality", F.lit(0.0)).alias("quality"))


def show(books: DataFrame, book_files: DataFrame, blocks: DataFrame, book_id: int, first: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One work, its files by role, and its first blocks."""
    return books.where(F.col("id") == book_id), book_files.where(F.col("book_id") == book_id).orderBy("role", "path"), blocks.where(F.col("book_id") == book_id).dropDuplicates(["seq"]).orderBy("seq").limit(first)
