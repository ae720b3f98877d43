"""From the manifest to what is to be read how: representatives, exploded books, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T
from quire.operators.report import EBOOKS

#: Folder names that are no titles, and the limits of an exploded book.
GENERIC_DIRS = ("files", "file", "html", "htm", "xhtml", "text", "texts", "book", "books", "ebook", "ebooks", "chapters", "content", "contents", "data", "pages", "images", "oebps", "ops", "www", "output", "export")
MIN_FILES, DIGIT_SHARE, PREFIX = 8, 0.7, 6


def candidates(files: DataFrame) -> DataFrame:
    """Rows with content that can be read, office documents included whatever their status."""
    readable = (F.col("status") == "ok") & F.col("format").isin(*EBOOKS) | (F.col("format") == "doc")
    return files.where(F.col("sha256").isNotNull() & readable)


def representatives(files: DataFrame) -> DataFrame:
    """Of each content the row with the shortest path (then the first by code point), with the number of copies."""
    best = files.groupBy("sha256").agg(F.min(F.struct(F.length("path").alias("n"), F.col("path"))).alias("x"), (F.count("*") - 1).alias("copies"))
    keys = best.select("sha256", F.col("x.path").alias("path"), "copies")
    return files.dropDuplicates(["sha256", "path"]).join(keys, ["sha256", "path"])


def is_lock_file(path: Column) -> Column:
    return T.basename(path).rlike(r"^(~\$|\.~lock)")


def dir_title(folder: Column) -> Column:
    """The nearest folder name that reads like a title once leading numbers are gone; else the last name."""
    names = F.reverse(F.split(folder, "/"))
    clean = F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"^[\d\s_.\-]+", "")))
    fit = F.filter(clean, lambda n: (n != "") & ~F.lower(n).isin(*GENERIC_DIRS))
    return F.when(F.size(fit) > 0, F.substring(F.get(fit, F.lit(0)), 1, 200)).otherwise(F.get(names, F.lit(0)))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters two strings begin with alike."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.when(n > 0, F.coalesce(F.array_max(at), F.lit(0))).otherwise(F.lit(0))


def exploded_dirs(reps: DataFrame) -> DataFrame:
    """Folders of html files that are the chapters of one book: many files with numbered or alike names.

    The common prefix of all names is that of the first and the last name in order.
    """
    html = reps.where("format = 'html'").select(T.parent(F.col("path")).alias("folder"), T.stem(F.col("path")).alias("stem"))
    by = html.groupBy("folder").agg(F.count("*").alias("files"), F.avg(F.col("stem").rlike(r"\d").cast("double")).alias("digits"), F.min("stem").alias("lo"), F.max("stem").alias("hi"))
    by = by.withColumn("prefix", common_prefix_length(F.col("lo"), F.col("hi")))
    big = by.where((F.col("files") >= MIN_FILES) & ((F.col("digits") >= DIGIT_SHARE) | (F.col("prefix") >= PREFIX)))
    return big.select("folder", "files", dir_title(F.col("folder")).alias("title"))


def routes(files: DataFrame, known: DataFrame) -> DataFrame:
    """``path, sha256, outcome`` of every representative: how it is to be read, or why it isn't.

    known: sha256 already taken in. Order of the rules: lock file, known, exploded html, then by format and text layer.
    """
    reps = representatives(candidates(files))
    dirs = exploded_dirs(reps).select("folder", F.lit(True).alias("exploded"))
    have = known.where("sha256 IS NOT NULL").select("sha256").distinct().withColumn("known", F.lit(True))
    df = reps.withColumn("folder", T.parent(F.col("path"))).join(dirs, "folder", "left").join(have, "sha256", "left")
    fmt, layer = F.col("format"), F.coalesce("text_class", F.lit(""))
    outcome = (
        F.when(is_lock_file(F.col("path")), "lock_artifact")
        .when(F.col("known"), "already_ingested")
        .when((fmt == "html") & F.col("exploded"), "exploded_html")
        .when((fmt == "pdf") & layer.isin("text", "mixed"), "pdf")
        .when((fmt == "pdf") & (layer == "scanned") | (fmt == "djvu"), "register")
        .when(fmt == "pdf", "empty_pdf")
        .when(fmt.isin("mobi", "doc"), "convert")
        .otherwise(fmt)
    )
    return df.select("path", "sha256", outcome.alias("outcome"))


def exploded_members(files: DataFrame) -> DataFrame:
    """Members of exploded books in natural order; the first is primary."""
    reps = representatives(candidates(files)).where("format = 'html'").withColumn("folder", T.parent(F.col("path")))
    w = W.partitionBy("folder").orderBy(T.natural_key(F.col("path")), "path")
    placed = reps.join(exploded_dirs(reps).select("folder"), "folder", "left_semi").withColumn("position", F.row_number().over(w))
    return placed.select("folder", "path", "position", F.when(F.col("position") == 1, "primary").otherwise("member").alias("role"))
