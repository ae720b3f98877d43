"""BM25 over postings, made on the spot or kept as an index that grows by versions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quire.functions import text as T
from quire.runtime import discard, materialize

K1, B, LEAST_IDF, DIGITS = 1.2, 0.75, 1e-6, 9
#: Changes when the tokens or the tables of stored postings do: an index of another form isn't read.
FORM = 1


def postings(passages: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, term, tf``: one row per passage and distinct folded token."""
    return passages.select(key, F.explode(T.index_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(passages: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, dl``: tokens of each passage; null and empty have none."""
    return passages.select(key, F.coalesce(F.size(T.index_tokens(F.col(text))), F.lit(0)).alias("dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, times``: a repeated word of a query weighs as often as it stands there. queries: query_id, query."""
    split = queries.select("query_id", F.explode(T.query_tokens(F.col("query"))).alias("w")).select("query_id", F.explode(T.index_tokens(F.col("w"))).alias("term"))
    return split.groupBy("query_id", "term").agg(F.count("*").alias("times"))


class Postings:
    """An inverted index under a shared path, kept by versions: ``terms`` (term, key, tf, dl), sorted by term, ``docs``
    (key, dl) and ``gone`` (keys whose rows of earlier versions no longer count). A version counts once its mark is
    written, after its tables."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _fs(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs("done")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(where)) if fs.exists(where) else []

    def write(self, version: int, passages: DataFrame | None = None, gone: DataFrame | None = None, text: str = "text") -> None:
        """Add passages (key, text) as ``version`` and take the keys in ``gone`` out of all earlier ones. A changed
        passage is both. Doing a version again writes the same again."""
        at = f"{version:09d}"
        if passages is not None:
            # the tokens are made once, and both tables read from them
            tokens = materialize(passages.select(self.key, T.index_tokens(F.col(text)).alias("tokens")).select(self.key, F.coalesce(F.size("tokens"), F.lit(0)).alias("dl"), "tokens"), free=False)
            rows = tokens.select(self.key, "dl", F.explode("tokens").alias("term")).groupBy("term", self.key, "dl").agg(F.count("*").alias("tf"))
            # a term that is in most passages is spread over several files, each of which holds few terms
            rows.repartitionByRange("term", self.key).sortWithinPartitions("term").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/terms/{at}")
            tokens.select(self.key, "dl").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/docs/{at}")
            discard(tokens)
        if gone is not None:
            gone.select(self.key).distinct().write.mode("overwrite").parquet(f"{self.path}/gone/{at}")
        fs, where = self._fs(f"done/{at}")
        fs.create(where, True).close()

    def _read(self, name: str) -> DataFrame:
        """The live rows of a table."""
        done = self.versions()
        have = lambda kind: [v for v in done if (x := self._fs(f"{kind}/{v:09d}"))[0].exists(x[1])]
        parts = [self.spark.read.parquet(f"{self.path}/{name}/{v:09d}").withColumn("_v", F.lit(v)) for v in have(name)]
        if not parts:
            raise ValueError(f"nothing is indexed under {self.path}")
        rows = reduce(DataFrame.unionByName, parts)
        dead = [self.spark.read.parquet(f"{self.path}/gone/{v:09d}").withColumn("_gone", F.lit(v)) for v in have("gone")]
        if dead:
            last = reduce(DataFrame.unionByName, dead).groupBy(self.key).agg(F.max("_gone").alias("_gone"))
            rows = rows.join(last, self.key, "left").where("_gone IS NULL OR _v >= _gone").drop("_gone")
        return rows.drop("_v")

    def terms(self) -> DataFrame:
        return self._read("terms")

    def docs(self) -> DataFrame:
        return self._read("docs")

    def search(self, queries: DataFrame, top: int) -> DataFrame:
        """As ``bm25``, without reading any text."""
        return _ranked(self.terms(), self.docs(), queries, top, self.key)


#: Query terms that may be broadcast; more are joined by shuffling.
BROADCAST_TERMS = 500_000


def _ranked(terms: DataFrame, docs: DataFrame, queries: DataFrame, top: int, key: str) -> DataFrame:
    """The best ``top`` of each query, found by bounds on the score of each term.

    A query's terms are ordered by the most each can add. The scores by its rarest terms alone give a score that its
    best ``top`` reach at least; terms that together can't add as much (the common ones) find no passage of their own,
    and are looked up only for passages that may still get among the best.
    """
    asked = materialize(query_terms(queries), free=False)
    few = asked.count() <= BROADCAST_TERMS
    small = F.broadcast if few else lambda df: df
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = materialize(terms.join(small(asked.select("term").distinct()), "term", "left_semi").select("term", key, "tf", "dl"), free=False)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    w = W.partitionBy("query_id").orderBy(F.col("most").desc(), "term")
    weighted = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (F.col("times") * idf * (K1 + 1)).alias("most"), "df", "avgdl")
    before = F.coalesce(F.sum("df").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("most").over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    weighted = materialize(weighted.select("*", before.alias("before"), rest.alias("rest")), free=False)
    # this much of its most does a term add to a passage
    part = F.col("most") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    def scores(of: DataFrame) -> DataFrame:
        return hits.join(small(of), "term").select("query_id", key, part.alias("part"), "most")

    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    rare = scores(weighted.where(F.col("before") < top)).groupBy("query_id", key).agg(F.sum("part").alias("score"))
    reached = rare.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).groupBy("query_id").agg(F.when(F.count("*") == top, F.min("score")).alias("reached"))
    bound = materialize(weighted.join(reached, "query_id", "left").withColumn("finds", F.col("reached").isNull() | (F.col("rest") >= F.col("reached") - 1e-6)), free=False)
    found = scores(bound.where("finds")).groupBy("query_id", key).agg(F.sum("part").alias("score"))
    others = bound.where("NOT finds")
    if others.isEmpty():
        full = found
    else:
        more = others.groupBy("query_id").agg(F.sum("most").alias("more"), F.first("reached").alias("reached"))
        near = materialize(found.join(more, "query_id", "left").where("more IS NULL OR score + more >= reached - 1e-6").select("query_id", key, "score"), free=False)
        added = scores(others).join(near.select("query_id", key), ["query_id", key], "left_semi").groupBy("query_id", key).agg(F.sum("part").alias("added"))
        full = near.join(added, ["query_id", key], "left").select("query_id", key, (F.col("score") + F.coalesce("added", F.lit(0.0))).alias("score"))
    rounded = full.select("query_id", key, F.round("score", DIGITS).alias("score"))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


#: Queries scored at once, passages of the first and of the largest step, and how near a bound counts as reached.
QUERIES, FIRST, STEP, NEAR = 1024, 256, 4096, 1e-6


def _holding(tokens: DataFrame, terms: pa.Array, key: str) -> DataFrame:
    """``key, dl, terms, tfs``: of each passage its length and the given terms in it by number. tokens: key, tokens."""
    spark, kind = tokens.sparkSession, tokens.schema[key].dataType.simpleString()
    shared, n = spark.sparkContext.broadcast(terms), max(len(terms), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(pc.list_flatten(batch.column(1)), value_set=shared.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            cells, tf = np.unique((np.repeat(np.arange(len(size)), size) * n + at)[at >= 0], return_counts=True)
            first = pa.array(np.searchsorted(cells, np.arange(len(size) + 1) * n), pa.int32())
            lists = [pa.ListArray.from_arrays(first, pa.array(x, pa.int32())) for x in (cells % n, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), *lists], names=[key, "dl", "terms", "tfs"])

    return tokens.select(key, "tokens").mapInArrow(run, f"{key} {kind}, dl int, terms array<int>, tfs array<int>")


class _Block:
    """The best passages so far of some queries. ``of, term, most``: query by number, term by number and the most it can
    add, sorted by term."""

    def __init__(self, n: int, of: np.ndarray, term: np.ndarray, most: np.ndarray, top: int):
        self.n, self.of, self.term, self.most, self.top = n, of, term, most, top
        self.runs = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.ends = np.append(self.runs[1:], len(term))
        # what a term and all that add less can add together
        order = np.lexsort((term, -most, of))
        back = np.cumsum(most[order][::-1])[::-1]
        after = np.append(back, 0.0)[np.searchsorted(of[order], of[order], side="right")]
        self.rest = np.empty(len(of))
        self.rest[order] = back - after
        self.reached = np.full(n, -np.inf)
        self.q, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, cells: np.ndarray, part: np.ndarray) -> None:
        """Passages by key; ``cells``: term times passages plus passage, sorted, and what share of its most the term adds."""
        d = len(keys)
        finds = self.rest >= self.reached[self.of] - NEAR
        begin, end = (np.searchsorted(cells, (self.term[self.runs] + k) * d) for k in (0, 1))
        s = np.zeros((self.n, d))
        for a, b, x, y in zip(self.runs, self.ends, begin, end):
            if x < y and (f := finds[a:b]).any():
                s[np.ix_(self.of[a:b][f], cells[x:y] % d)] += self.most[a:b][f][:, None] * part[x:y]
        others = np.flatnonzero(~finds)
        more = np.bincount(self.of[others], self.most[others], self.n)
        q, p = np.nonzero(s >= np.maximum(self.reached - more - NEAR, 1e-300)[:, None])
        score = s[q, p]
        if len(others):
            others = others[np.argsort(self.of[others], kind="stable")]
            first = np.searchsorted(self.of[others], np.arange(self.n + 1))
            many = np.diff(first)[q]
            pair = np.repeat(np.arange(len(q)), many)
            entry = others[np.arange(len(pair)) - np.repeat(np.cumsum(many) - many - first[q], many)]
            cell = self.term[entry] * d + p[pair]
            at = np.minimum(np.searchsorted(cells, cell), max(len(cells) - 1, 0))
            score = score + np.bincount(pair, np.where(cells[at] == cell, self.most[entry] * part[at], 0.0), len(q)) if len(pair) else score
        score = np.round(score, DIGITS)
        ok = score >= self.reached[q]
        q, score, key = (np.concatenate(x) for x in ((self.q, q[ok]), (self.score, score[ok]), (self.key, keys[p[ok]])))
        order = np.lexsort((key, -score, q))
        q, score, key = q[order], score[order], key[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.top - 1
        self.reached[q[last]] = score[last]
        ok = rank < self.top
        self.q, self.score, self.key = q[ok], score[ok], key[ok]


def _scored(held: DataFrame, asked: pa.Table, terms: pa.Array, top: int, key: str, kind: str) -> DataFrame:
    """As ``bm25``, from what ``_holding`` made, whose keys differ: each task scores its passages in steps against all
    queries in blocks and keeps the best of each. Terms that together can't add what a query's best have reached are looked
    up only for passages that may still get among them."""
    spark = held.sparkSession
    stats = held.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    df = np.zeros(len(terms))
    counted = held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
    df[counted["t"].to_numpy()] = counted["df"].to_numpy()
    idf = np.maximum(np.log((stats.n - df + 0.5) / (df + 0.5)), LEAST_IDF)
    ids = pc.unique(asked["query_id"])
    of = pc.index_in(asked["query_id"], value_set=ids).to_numpy().astype(np.int64)
    term = pc.index_in(asked["term"], value_set=terms).to_numpy().astype(np.int64)
    most = asked["times"].to_numpy() * idf[term] * (K1 + 1)
    order = np.lexsort((of, term))
    shared = spark.sparkContext.broadcast((of[order], term[order], most[order], len(ids), stats.avgdl))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, term, most, n, avgdl = shared.value
        blocks = []
        for k in range(0, n, QUERIES):
            mine = (of >= k) & (of < k + QUERIES)
            blocks.append(_Block(min(QUERIES, n - k), of[mine] - k, term[mine], most[mine], top))
        step = FIRST
        for pdf in batches:
            a = 0
            while a < len(pdf):
                x = pdf.iloc[a : a + step]
                a, step = a + step, min(2 * step, STEP)
                size = x["terms"].map(len).to_numpy()
                if not size.sum():
                    continue
                doc, tf = np.repeat(np.arange(len(x)), size), np.concatenate(x["tfs"].tolist()).astype(float)
                cells = np.concatenate(x["terms"].tolist()).astype(np.int64) * len(x) + doc
                part = tf / (tf + K1 * (1 - B + B * x["dl"].to_numpy()[doc] / avgdl))
                by = np.argsort(cells)
                for block in blocks:
                    block.add(x[key].to_numpy().astype(np.int64), cells[by], part[by])
        for k, block in enumerate(blocks):
            if len(block.q):
                yield pd.DataFrame({"q": block.q + k * QUERIES, key: block.key, "score": block.score})

    # as many tasks as run side by side, as each of them may send the best of every query
    found = held.where(F.size("terms") > 0).coalesce(spark.sparkContext.defaultParallelism).mapInPandas(run, f"q long, {key} {kind}, score double")
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), F.col(key)))).where(F.col("rank") <= top)
    names = spark.createDataFrame(pa.table({"q": np.arange(len(ids)), "query_id": ids}))
    return best.join(F.broadcast(names), "q").select("query_id", key, "score", "rank")


def bm25(passages: DataFrame, queries: DataFrame, top: int, key: str = "id", text: str = "text") -> DataFrame:
    """``query_id, key, score, rank``: the best ``top`` passages of each query by BM25, ties by key.

    Document frequencies and lengths are of all passages. A query without a token finds nothing. The passages are read
    here and now; ``Postings`` keeps what was read.
    """
    tokens = passages.select(key, T.index_tokens(F.col(text)).alias("tokens"))
    kind, qkind = passages.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    asked = materialize(query_terms(queries), free=False)
    whole = ("tinyint", "smallint", "int", "bigint")
    if kind in whole and qkind in whole and asked.count() <= BROADCAST_TERMS and asked.where("query_id IS NULL").isEmpty():
        found = asked.toArrow()
        terms = pc.unique(found["term"])
        held = materialize(_holding(tokens, terms, key))
        if held.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
            out = _scored(held, found, terms, top, key, kind)
            return out.select(F.col("query_id").cast(qkind).alias("query_id"), key, "score", "rank")
        discard(held)
    # too many terms for every executor, or passages of one key, whose tokens count together
    tokens = tokens.select(key, F.coalesce(F.size("tokens"), F.lit(0)).alias("dl"), "tokens")
    rows = tokens.select(key, "dl", F.explode("tokens").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    return _ranked(rows, tokens.select(key, "dl"), queries, top, key)
