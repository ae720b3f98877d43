"""Neighbours and running sums in the order of a group, however large the group.

A window over a group sorts all of it in one task. Here rows are ordered in chunks of a group, and only what crosses the
chunks' edges, one row a chunk, is then ordered over the whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

CHUNK = 2048


def _chunk(order: str, size: int) -> F.Column:
    return F.floor(F.col(order) / F.lit(size)).alias("_chunk")


def neighbour(df: DataFrame, key: str, order: str, columns: list[str], name: str, forward: bool = False, size: int = CHUNK, along: DataFrame | None = None) -> DataFrame:
    """``df`` with a struct ``name`` of ``columns`` of the row before (or after) within ``key`` by ``order``, null where there
    is none. ``order`` is a whole number, not null, and stands once in a group. A row of a null key has no neighbour. ``along``: columns of the groups (one row a key), which
    come to the rows by the same join."""
    rows = df.withColumn("_chunk", _chunk(order, size))
    near = F.struct(*columns)
    inside = W.partitionBy(key, "_chunk").orderBy(order)
    rows = rows.withColumn("_near", (F.lead if forward else F.lag)(near).over(inside))
    # of each chunk the row at its edge, by partial aggregation: next to nothing is shuffled
    edges = df.groupBy(key, _chunk(order, size)).agg((F.min_by if forward else F.max_by)(near, order).alias("_edge"))
    across = edges.select(F.col(key).alias("_key"), F.col("_chunk").alias("_of"), (F.lead if forward else F.lag)("_edge").over(W.partitionBy(key).orderBy("_chunk")).alias("_across"))
    if along is not None:
        across = across.join(along.withColumnRenamed(key, "_key"), "_key", "left")
    out = rows.join(across, (rows[key] == across["_key"]) & (rows["_chunk"] == across["_of"]), "left")
    return out.withColumn(name, F.when(F.col(key).isNotNull(), F.coalesce("_near", "_across"))).drop("_chunk", "_near", "_key", "_of", "_across")


def running(df: DataFrame, key: str, order: str, value: str, name: str, size: int = CHUNK) -> DataFrame:
    """``df`` with the sum ``name`` of ``value`` over all rows of ``key`` up to and with the row, by ``order``; null for a null key."""
    rows = df.withColumn("_chunk", _chunk(order, size))
    inside = W.partitionBy(key, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_in", F.sum(value).over(inside))
    sums = df.select(key, _chunk(order, size), value).groupBy(key, "_chunk").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    across = sums.select(F.col(key).alias("_key"), F.col("_chunk").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    out = rows.join(across, (rows[key] == across["_key"]) & (rows["_chunk"] == across["_of"]), "left")
    return out.withColumn(name, F.coalesce("_in", F.lit(0)) + F.col("_before")).drop("_chunk", "_in", "_key", "_of", "_before")


def chapter_runs(blocks: DataFrame, size: int = CHUNK) -> DataFrame:
    """``blocks`` (book_id, seq once each, chapter_idx and more) with ``run``: the number of the run of blocks of one chapter
    in reading order, from 1; consecutive blocks, not all of a chapter's."""
    near = neighbour(blocks, "book_id", "seq", ["seq", "chapter_idx"], "_last", size=size)
    new = (F.col("_last").isNull() | ~F.col("chapter_idx").eqNullSafe(F.col("_last.chapter_idx"))).cast("int")
    return running(near.withColumn("_new", new), "book_id", "seq", "_new", "run", size=size).drop("_last", "_new")
