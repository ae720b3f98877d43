"""Aggregates over the manifest of surveyed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T
from quire.runtime import materialize

#: Formats of the manifest, and the constants of the size estimates.
EBOOKS = ("pdf", "epub", "mobi", "txt", "html", "fb2", "djvu")
ARCHIVES, PROBLEMS = ("zip", "rar", "7z"), ("corrupt", "encrypted", "drm", "error")
WORDS_PER_PAGE, CHUNK_WORDS, OVERLAP, DIMENSIONS, GRAPH_BYTES, GB = 300, 300, 0.15, 1024, 150, 1024**3
EMBED_RATE, OCR_RATE, RAM_GB = 8.0, 1.0, 64


def latest(files: DataFrame) -> DataFrame:
    """The manifest proper: of each path the newest survey. Exact copies of a row count once; of different rows of
    one instant the first by sha256, size and status is kept. Rows without a path are left out."""
    w = W.partitionBy("path").orderBy(F.col("surveyed_at").desc_nulls_last(), F.col("sha256").asc_nulls_last(), F.col("size"), F.col("status"))
    return files.where("path IS NOT NULL").withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def is_ebook() -> Column:
    return F.col("format").isin(*EBOOKS)


def is_usable() -> Column:
    return is_ebook() & (F.col("status") == "ok")


def group_counts(files: DataFrame, key: str) -> DataFrame:
    """Files and bytes by ``key``, null and empty as unknown."""
    k = F.coalesce(F.when(F.col(key) != "", F.col(key)), F.lit("unknown"))
    return files.groupBy(k.alias(key)).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def text_layers(files: DataFrame) -> DataFrame:
    k = F.coalesce(F.when(F.col("text_class") != "", F.col("text_class")), F.lit("unknown"))
    return files.where(is_ebook()).groupBy(k.alias("text_class")).agg(F.count("*").alias("files"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))


def exact_duplicates(files: DataFrame) -> DataFrame:
    """One row per content that several paths hold: copies, wasted bytes and the first five paths."""
    groups = files.where("sha256 IS NOT NULL AND sha256 <> ''").groupBy("sha256").agg(F.count("*").alias("copies"), F.min("size").alias("size"), F.min("path").alias("first_path"))
    return groups.where("copies > 1").select("sha256", "copies", ((F.col("copies") - 1) * F.col("size")).alias("wasted_bytes"), "first_path")


def duplicate_totals(files: DataFrame) -> DataFrame:
    d = exact_duplicates(files)
    return d.agg(F.count("*").alias("exact_groups"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("redundant_files"), F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("wasted_bytes"))


def duplicate_examples(files: DataFrame, groups: int = 5) -> DataFrame:
    """All paths of the first groups of copies (by hash)."""
    first = exact_duplicates(files).orderBy("sha256").limit(groups).select("sha256")
    return files.join(F.broadcast(first), "sha256").select("sha256", "path")


def works_estimate(files: DataFrame) -> DataFrame:
    """Distinct normalised titles of at least 8 characters among usable files, and how many have several files."""
    titles = files.where(is_usable()).select(T.title_key(F.col("title")).alias("k")).where(F.length("k") >= 8).groupBy("k").agg(F.count("*").alias("n"))
    return titles.agg(F.count("*").alias("unique_titles"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("titles_in_multiple_files"))


def problems(files: DataFrame) -> DataFrame:
    return files.where(F.col("status").isin(*PROBLEMS)).select("status", "path", "format", "error")


def problem_counts(files: DataFrame) -> DataFrame:
    return problems(files).groupBy("status").agg(F.count("*").alias("files"))


def archives(files: DataFrame) -> DataFrame:
    inside = F.aggregate(F.map_values(F.coalesce("contains", F.create_map().cast("map<string,int>"))), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    found = files.where(F.col("format").isin(*ARCHIVES) & (F.col("status") == "unsupported"))
    return found.agg(F.count("*").alias("archives"), F.coalesce(F.sum(inside), F.lit(0)).alias("ebooks_inside"))


def totals(files: DataFrame) -> DataFrame:
    usable = is_usable().cast("long")
    known = (is_usable() & F.col("language").isNotNull() & (F.col("language") != "")).cast("long")
    share = F.when(F.sum(usable) > 0, F.round(100 * F.sum((is_usable() & F.coalesce("has_metadata", F.lit(False))).cast("long")) / F.sum(usable), 1)).otherwise(F.lit(0.0))
    z = lambda c: F.coalesce(c, F.lit(0))
    return files.agg(F.count("*").alias("files"), z(F.sum("size")).alias("bytes"), z(F.sum(is_ebook().cast("long"))).alias("ebook_files"), z(F.sum(usable)).alias("usable_ebooks"), z(F.sum(usable) - F.sum(known)).alias("unknown_language"), F.coalesce(share, F.lit(0.0)).alias("metadata_pct"))


def size_inputs(files: DataFrame) -> DataFrame:
    """Words that can be extracted, and pages that are only pictures (those of mixed files count half)."""
    pages = F.coalesce("pages", F.lit(0))
    scanned = F.when(F.col("text_class") == "scanned", pages * 1.0).when(F.col("text_class") == "mixed", pages * 0.5).otherwise(0.0)
    usable = files.where(is_usable())
    return usable.agg(F.coalesce(F.sum("word_estimate"), F.lit(0)).alias("words_extractable"), F.coalesce(F.sum(scanned), F.lit(0.0)).cast("long").alias("scanned_pages"))


def estimates(inputs: DataFrame, embed_rate: float = EMBED_RATE, ocr_rate: float = OCR_RATE) -> DataFrame:
    """Downstream sizes: passages, memory and disk of their vectors, hours of embedding and of recognition."""
    df = inputs.withColumn("words_from_ocr", F.col("scanned_pages") * WORDS_PER_PAGE)
    df = df.withColumn("words_total", F.col("words_extractable") + F.col("words_from_ocr"))
    df = df.withColumn("chunks", (F.col("words_total") / CHUNK_WORDS * (1 + OVERLAP)).cast("long"))
    df = df.withColumn("vector_ram_gb", F.round(F.col("chunks") * (DIMENSIONS + GRAPH_BYTES) / GB, 4))
    df = df.withColumn("vector_disk_gb", F.round(F.col("chunks") * (DIMENSIONS * 4) / GB, 4))
    df = df.withColumn("embed_hours", F.round(F.col("chunks") / embed_rate / 3600, 4)).withColumn("ocr_hours", F.round(F.col("scanned_pages") / ocr_rate / 3600, 4))
    fits = F.when(F.col("vector_ram_gb") < RAM_GB * 0.5, "comfortable").when(F.col("vector_ram_gb") < RAM_GB * 0.8, "tight").otherwise("on disk")
    return df.withColumn("ram_fit", fits).withColumn("embed_time", T.humanize_hours(F.col("embed_hours"))).withColumn("ocr_time", T.humanize_hours(F.col("ocr_hours")))


def languages(files: DataFrame) -> DataFrame:
    """Usable files and their bytes by language; files without one are counted in the totals."""
    return group_counts(files.where(is_usable() & (F.col("language") != "")), "language")


def recommendations(files: DataFrame) -> DataFrame:
    """``topic, amount``: what the manifest calls for, with the figure behind it; ``proceed`` where it calls for nothing.

    office files to convert; scanned files above a quarter of the usable ones; a vector index above half of the memory;
    copies that waste more than 5 GB; archives to unpack; an unknown language on more than 30 % of the usable files.
    """
    usable = is_usable().cast("long")
    counts = files.agg(
        F.sum((F.col("format") == "doc").cast("long")).alias("office"), F.sum(usable).alias("usable"),
        F.sum((is_ebook() & (F.col("text_class") == "scanned")).cast("long")).alias("scanned"), F.sum((is_usable() & (F.coalesce("language", F.lit("")) == "")).cast("long")).alias("unknown"),
    )
    # all of these are single rows
    one = counts.crossJoin(duplicate_totals(files)).crossJoin(archives(files)).crossJoin(estimates(size_inputs(files)).select("vector_ram_gb"))
    one = one.na.fill(0)
    share = lambda c: F.col(c) / F.greatest("usable", F.lit(1))
    rules = (
        ("convert_office", F.col("office") > 0, "office"), ("recognise_scans", (F.col("usable") > 0) & (share("scanned") > 0.25), "scanned"),
        ("index_on_disk", F.col("vector_ram_gb") > RAM_GB * 0.5, "vector_ram_gb"), ("skip_copies", F.col("wasted_bytes") > 5 * GB, "redundant_files"),
        ("unpack_archives", F.col("archives") > 0, "archives"), ("detect_languages", (F.col("usable") > 0) & (share("unknown") > 0.3), "unknown"),
    )
    made = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(topic).alias("topic"), F.col(c).cast("double").alias("amount"))) for topic, when, c in rules]))
    none = F.array(F.struct(F.lit("proceed").alias("topic"), F.lit(0.0).alias("amount")))
    return one.select(F.inline(F.when(F.size(made) > 0, made).otherwise(none)))


def render(row) -> str:
    """The report (its one row) as text for a console: a block for each part."""
    import json

    lines = []
    for part, value in json.loads(row[0]).items():
        lines.append(part)
        for item in value if isinstance(value, list) else [value]:
            lines.append("  " + "  ".join(f"{k}: {v:,}" if isinstance(v, int) else f"{k}: {v}" for k, v in item.items()))
    return "\n".join(lines)


def report(files: DataFrame) -> DataFrame:
    """The whole report as one row of JSON, every part computed by its own aggregate over the manifest as stored once."""
    m = materialize(latest(files), free=False)
    one = totals(m)
    parts = {
        "formats": group_counts(m, "format"), "statuses": group_counts(m, "status"), "text_layer": text_layers(m), "duplicates": duplicate_totals(m), "works": works_estimate(m),
        "problems": problem_counts(m), "archives": archives(m), "languages": languages(m), "estimates": estimates(size_inputs(m)), "recommendations": recommendations(m),
    }
    row = one.select(F.to_json(F.struct("*")).alias("totals"))
    for name, df in parts.items():
        # each part is an aggregate by an enumerated key: a handful of rows
        row = row.join(df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias(name)), F.lit(True))
    return row.select(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{c}":'), F.col(c)) for c in row.columns]), F.lit("}")).alias("report"))
