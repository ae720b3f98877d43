"""Golden sets: which expected works a search finds, and where."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions import text as T

CASES = "case_id int, query string, book_id long, book_match string, must_contain string, note string"


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a YAML list; each needs a query and a book (an id, or a part of title or author)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        items = yaml.safe_load(f) or []
    rows = []
    for i, item in enumerate(items, 1):
        if "query" not in item or "book" not in item:
            raise ValueError(f"case {i} needs a query and a book: {item!r}")
        by_id = isinstance(item["book"], int)
        rows.append((i, item["query"], item["book"] if by_id else None, None if by_id else str(item["book"]), item.get("must_contain"), item.get("note")))
    return spark.createDataFrame(rows, CASES)


def _fits(hit_book, title, author, text):
    by_id = F.col("c.book_id").isNotNull() & (hit_book == F.col("c.book_id"))
    needle = T.norm_match(F.col("c.book_match"))
    by_name = F.col("c.book_id").isNull() & (F.contains(T.norm_match(title), needle) | F.contains(T.norm_match(author), needle))
    phrase = F.col("c.must_contain").isNull() | F.contains(T.norm_match(text), T.norm_match(F.col("c.must_contain")))
    return (by_id | by_name) & phrase


def first_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """``case_id, rank`` of the first right hit, null if there is none. hits: case_id, rank, book_id, title, author, text."""
    joined = cases.alias("c").join(hits.alias("h"), F.col("c.case_id") == F.col("h.case_id"), "left")
    right = _fits(F.col("h.book_id"), F.col("h.title"), F.col("h.author"), F.col("h.text"))
    return joined.groupBy(F.col("c.case_id").alias("case_id")).agg(F.min(F.when(right, F.col("h.rank"))).alias("rank"))


def metrics(ranks: DataFrame) -> DataFrame:
    """Cases, hits, hit rate and mean reciprocal rank; rates of no cases are 0."""
    n, hits = F.count("*"), F.count("rank")
    return ranks.agg(n.alias("cases"), hits.alias("hits"), F.coalesce(F.round(hits / F.nullif(n, F.lit(0)), 6), F.lit(0.0)).alias("hit_rate"), F.coalesce(F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6), F.lit(0.0)).alias("mrr"))


def reachable(cases: DataFrame, books: DataFrame, passages: DataFrame) -> DataFrame:
    """``case_id, reachable``: whether any passage of a fitting work holds the phrase asked for. Here the part of title or
    author is a pattern with % and _, any case. Cases are few and broadcast when they are."""
    like = F.lower(F.concat(F.lit("%"), F.col("c.book_match"), F.lit("%")))
    name = F.expr("lower(b.title) LIKE lower(concat('%', c.book_match, '%')) OR lower(b.author) LIKE lower(concat('%', c.book_match, '%'))")
    by = F.when(F.col("c.book_id").isNotNull(), F.col("b.id") == F.col("c.book_id")).otherwise(like.isNotNull() & name)
    fits = cases.alias("c").join(books.select("id", "title", "author").alias("b"), by).select("c.case_id", F.col("b.id").alias("book_id"), "c.must_contain")
    hits = fits.join(passages.select("book_id", "text"), "book_id").where(F.col("must_contain").isNull() | F.contains(T.norm_match(F.col("text")), T.norm_match(F.col("must_contain"))))
    good = hits.select("case_id").distinct().withColumn("r", F.lit(True))
    return cases.select("case_id").join(good, "case_id", "left").select("case_id", F.coalesce("r", F.lit(False)).alias("reachable"))
