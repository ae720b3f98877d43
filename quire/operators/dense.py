"""Exact cosine search of a query set against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

#: Queries compared in one pass; a block of vectors is all that is ever broadcast.
BLOCK, DIGITS = 4096, 6


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(x, np.float64) for x in rows])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def cosine_top(vectors: DataFrame, queries: DataFrame, top: int, key: str = "vec_id", vector: str = "embedding", farthest: bool = False) -> DataFrame:
    """``query_id, key, score, rank``: the nearest (or farthest) ``top`` vectors of each query, ties by key.

    queries: query_id and a vector column. The commonest length among the queries' vectors counts (of equally common
    ones the longest); null vectors and those of another length find nothing and are not found; a vector of zeros has a similarity of 0 to all. Each partition keeps the best of its rows,
    so what is merged is at most ``top`` rows a query and partition.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()
    sign = 1.0 if farthest else -1.0
    found, batch = None, []

    def search(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r.query_id for r in rows], _unit([r[vector] for r in rows])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            best_k = np.empty((len(ids), 0), object)
            best_s = np.empty((len(ids), 0))
            for pdf in batches:
                ok = [x is not None and len(x) == matrix.shape[1] for x in pdf[vector]]
                pdf = pdf[ok]
                for i in range(0, len(pdf), 2048):
                    part = pdf.iloc[i : i + 2048]
                    s = np.round(matrix @ _unit(part[vector]).T, DIGITS)
                    keys = np.concatenate([best_k, np.broadcast_to(part[key].to_numpy().astype(object), s.shape)], axis=1)
                    s = np.concatenate([best_s, s], axis=1)
                    if s.shape[1] > top:
                        # by score, then by key
                        by_key = np.argsort(keys, axis=1, kind="stable")
                        keys, s = np.take_along_axis(keys, by_key, 1), np.take_along_axis(s, by_key, 1)
                        order = np.argsort(sign * s, axis=1, kind="stable")[:, :top]
                        keys, s = np.take_along_axis(keys, order, 1), np.take_along_axis(s, order, 1)
                    best_k, best_s = keys, s
            if best_k.size:
                yield pd.DataFrame({"query_id": np.repeat(ids, best_k.shape[1]), key: best_k.ravel(), "score": best_s.ravel()})

        return vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"query_id {qkind}, {key} {kind}, score double")

    asked = queries.select("query_id", vector).where(F.col(vector).isNotNull())
    widths = asked.groupBy(F.size(vector).alias("w")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("w").desc()).first()
    for r in asked.where(F.size(vector) == widths.w).toLocalIterator() if widths else ():
        batch.append(r)
        if len(batch) == BLOCK:
            found = search(batch) if found is None else found.unionByName(search(batch))
            batch = []
    if batch:
        found = search(batch) if found is None else found.unionByName(search(batch))
    if found is None:
        return spark.createDataFrame([], f"query_id {qkind}, {key} {kind}, score double, rank int")
    w = W.partitionBy("query_id").orderBy(F.col("score").asc() if farthest else F.col("score").desc(), F.col(key))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
