"""Quality of recognised pages against true text, and of engines against one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import text as T


_LETTERS = "".join(map(chr, range(0x100, 0xD800)))


def word_errors(read: Column, truth: Column) -> Column:
    """Word edits over the words of the true text: every distinct word becomes one character, then characters are compared."""
    # 55,040 characters below the surrogates: more distinct words than a page has
    letter = lambda known, w: F.substr(F.lit(_LETTERS), F.array_position(known, w).cast("int"), F.lit(1))
    spell = lambda known, ws: F.array_join(F.transform(ws, lambda w: letter(known, w)), "")
    both = F.struct(T.words(F.coalesce(read, F.lit(""))).alias("a"), T.words(F.coalesce(truth, F.lit(""))).alias("b"))
    edits = lambda x: T.bind(F.array_distinct(F.concat(x["a"], x["b"])), lambda known: F.levenshtein(spell(known, x["a"]), spell(known, x["b"])) / F.greatest(F.size(x["b"]), F.lit(1)))
    return T.bind(both, edits)


def page_texts(spark: SparkSession, root: str) -> DataFrame:
    """``engine, slug, page, text`` of outputs stored as ``engine/slug/page_0003.txt`` below ``root``."""
    parts = F.regexp_extract_all("path", F.lit(r"[^/]+"), F.lit(0))
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "page_*.txt").text(root, wholetext=True)
    named = raw.select("value", F.url_decode(F.regexp_replace(F.input_file_name(), r"\+", "%2B")).alias("path")).withColumn("p", parts)
    at = lambda k: F.element_at("p", -k)
    return named.select(at(3).alias("engine"), at(2).alias("slug"), F.regexp_extract(at(1), r"(\d+)", 1).cast("int").alias("page"), F.col("value").alias("text"))


def page_timings(spark: SparkSession, root: str) -> DataFrame:
    """``engine, slug, page, seconds`` of the files ``engine/timings.json`` (an object ``pages`` of seconds by slug/page)."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "timings.json").text(root, wholetext=True)
    pages = F.from_json(F.get_json_object("value", "$.pages"), "map<string,double>")
    rows = raw.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("engine"), F.explode(pages).alias("k", "seconds"))
    return rows.select("engine", F.split("k", "/")[0].alias("slug"), F.regexp_extract("k", r"(\d+)$", 1).cast("int").alias("page"), "seconds")


def with_timings(scored: DataFrame, timings: DataFrame) -> DataFrame:
    """Scored pages with the seconds they took; null where none were noted."""
    return scored.join(timings, ["engine", "slug", "page"], "left")


def score_pages(pages: DataFrame, truth: DataFrame, words: DataFrame) -> DataFrame:
    """Per engine and page: characters, error rates (null without true text), shares of dictionary words and of garbage.

    pages: engine, slug, page, text; truth: slug, page, truth; words: word (lower case).
    """
    p = pages.withColumn("text", T.ocr_normalize(F.col("text")))
    t = truth.select("slug", "page", T.ocr_normalize(F.col("truth")).alias("truth"))
    tokens = p.select("engine", "slug", "page", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿĀ-ž]{2,}"), F.lit(0))).alias("w"))
    known = words.select(F.lower("word").alias("w")).distinct().withColumn("k", F.lit(1))
    ratio = tokens.withColumn("w", F.lower("w")).join(known, "w", "left").groupBy("engine", "slug", "page").agg(F.round(F.avg(F.coalesce("k", F.lit(0))), 6).alias("dict_ratio"))
    out = p.join(t, ["slug", "page"], "left").join(ratio, ["engine", "slug", "page"], "left")
    return out.select("engine", "slug", "page", F.length("text").alias("chars"), F.round(T.cer(F.col("text"), F.col("truth")), 6).alias("cer"), F.when(F.col("truth").isNotNull(), F.round(word_errors(F.col("text"), F.col("truth")), 6)).alias("wer"), "dict_ratio", F.round(T.garbage_ratio(F.col("text")), 6).alias("garbage_ratio"))


def means(scored: DataFrame) -> DataFrame:
    """Means by engine and slug and by engine alone (slug null), nulls left out of each. Exact halves are rounded up."""
    by = scored.rollup("engine", "slug").agg(*[F.round(F.avg(c) + 1e-10, 6).alias(c) for c in ("cer", "wer", "dict_ratio", "garbage_ratio")], F.count("*").alias("pages"))
    return by.where("engine IS NOT NULL")


def pairwise(pages: DataFrame) -> DataFrame:
    """Mean character error between each two engines over the pages both have, the most alike first."""
    p = pages.select("engine", "slug", "page", T.ocr_normalize(F.col("text")).alias("text"))
    a, b = p.alias("a"), p.alias("b")
    both = a.join(b, ["slug", "page"]).where("a.engine < b.engine")
    out = both.groupBy(F.col("a.engine").alias("first"), F.col("b.engine").alias("second")).agg(F.count("*").alias("pages"), F.round(F.avg(T.cer(F.col("a.text"), F.col("b.text"))), 6).alias("cer"))
    return out.orderBy(F.coalesce(F.nullif("cer", F.lit(0.0)), F.lit(9.0)), "first", "second")
