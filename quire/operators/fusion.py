"""Reciprocal rank fusion, hybrid search and hydration of hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.operators import dense, lexical

K, CANDIDATES, DIGITS = 60, 50, 9


def rrf(rankings: list[DataFrame], key: str = "id", k: int = K) -> DataFrame:
    """``query_id, key, score``: the sum over rankings of 1 / (k + rank). rankings: query_id, key, rank from 1."""
    every = None
    for r in rankings:
        part = r.select("query_id", key, "rank")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), DIGITS).alias("score"))


def top_per_query(scored: DataFrame, limit: int, key: str = "id") -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def hydrate(hits: DataFrame, passages: DataFrame, details: DataFrame, key: str = "id", on: str | None = None) -> DataFrame:
    """Hits with the columns of their passage and of its work; hits whose passage is gone are dropped."""
    out = hits.join(passages, key)
    return out.join(details, on or key) if details is not None else out


def works_of(hits: DataFrame, passages: DataFrame, books: DataFrame, paths: DataFrame, key: str = "id") -> DataFrame:
    """Hits with their passage, the title, author and language of its work and the path of the work's primary file
    (null where it has none); hits whose passage or work is gone are dropped. passages: key, book_id and more."""
    details = books.select(F.col("id").alias("book_id"), "title", "author", "language").join(paths, "book_id", "left")
    return hydrate(hits, passages.where("book_id IS NOT NULL"), details, key, "book_id")


def hybrid(passages: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10, candidates: int = CANDIDATES, rerank: Callable[[Column, Column], Column] | None = None, key: str = "id", index: lexical.Postings | None = None) -> DataFrame:
    """``query_id, key, score, rank``: both legs' best candidates, fused; optionally reranked by a column function of
    the query and the passage text.

    passages: key, text; vectors: key, embedding; queries: query_id, query, embedding (either may be null, which
    leaves that leg out for the query); index: stored postings of the passages, else they are read here.
    """
    asked = queries.select("query_id", "query")
    lex = index.search(asked, candidates) if index is not None else lexical.bm25(passages, asked, candidates, key)
    den = dense.cosine_top(vectors, queries.select("query_id", "embedding"), candidates, key)
    fused = rrf([lex, den], key)
    if rerank is None:
        return top_per_query(fused, limit, key)
    pool = top_per_query(fused, candidates, key).select("query_id", key).join(passages.select(key, "text"), key).join(queries.select("query_id", "query"), "query_id")
    return top_per_query(pool.select("query_id", key, rerank(F.col("query"), F.col("text")).alias("score")), limit, key)
