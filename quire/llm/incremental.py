"""New batches against all history, by persisted cells over MinHash vectors.

Vectors have POSITIONS minima and count as near when at least ``least`` of them are equal, so at most
POSITIONS - least = 51 differ. The positions are cut into GROUPS = 26 groups; a vector's cells are all choices of
one position less than a group has. As long as 2 * GROUPS exceeds the differences allowed, two near vectors differ
in at most one position of some group and so share a cell: a vector seen in none of the cells of t groups differs
in at least 2t positions, and once 2t exceeds the allowed distance no near match can remain unseen. The rerank
compares the full vectors.

Cells, full vectors and content hashes are stored as versions of an index, one for each batch. A batch is probed
against the versions before it and then appended. Of the stored cells only the keys are scanned, by a semi-join with
the batch's keys before anything moves; full vectors are read of the cells that are met. Equal vectors are stored
once, with the first record that brought them. A version counts once its mark is written, after all of its tables,
so a stopped run leaves nothing behind that is half there; doing a batch again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quire.llm.hashing import mix
from quire.llm.neardup import only
from quire.runtime import discard, materialize, release, shared_dir

POSITIONS, GROUPS, SHARE = 128, 26, 0.6
#: A cell's rank is that of the first record with its vector.
RECORDS, CELLS = "rank long, sha256 string, cls long, sig binary", "key long, cls long, rank long"
#: The rank of what was stored before a batch came.
_BEFORE = -(1 << 63)


def _cell_positions() -> list[np.ndarray]:
    """Positions of each cell key: of every group all choices of one less than its size."""
    out = []
    for part in np.array_split(np.arange(POSITIONS), GROUPS):
        out += [np.delete(part, k) for k in range(len(part))]
    return out


def least_equal(share: float) -> int:
    return int(np.ceil(round(share * POSITIONS, 6)))


def packed(records: DataFrame) -> DataFrame:
    """RECORDS of records (rank, sha256, minhash): ``sig`` holds the 32-bit minima and ``cls`` their hash; both are null
    where the vector is null, holds a null or isn't of POSITIONS numbers."""
    ok = (F.size("minhash") == POSITIONS) & ~F.exists("minhash", lambda x: x.isNull())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["sig"] = [None if x is None else np.asarray(x, np.int64).astype(np.uint32).tobytes() for x in pdf.pop("v")]
            yield pdf

    slim = records.select(F.col("rank").cast("long").alias("rank"), "sha256", F.when(ok, F.xxhash64("minhash")).alias("cls"), F.when(ok, F.col("minhash")).alias("v"))
    return slim.mapInPandas(pack, RECORDS)


def cells(vectors: DataFrame) -> DataFrame:
    """CELLS of distinct vectors (cls, sig, rank): all cells of each."""
    places = _cell_positions()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 2000):
                part = pdf.iloc[i : i + 2000]
                sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(-1, POSITIONS).astype(np.uint64)
                keys = np.empty((len(part), len(places)), np.uint64)
                for k, at in enumerate(places):
                    key = np.full(len(part), k + 1, np.uint64)
                    for p in at:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, p])
                    keys[:, k] = key
                yield pd.DataFrame({"key": keys.ravel().view(np.int64), "cls": np.repeat(part["cls"].to_numpy(), len(places)), "rank": np.repeat(part["rank"].to_numpy(), len(places))})

    return vectors.select("cls", "sig", "rank").mapInPandas(run, CELLS)


def _equal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            a, b = (np.frombuffer(b"".join(pdf[c]), np.uint32).reshape(-1, POSITIONS) for c in ("sa", "sb"))
            yield pdf[["a", "b"]].assign(equal=(a == b).sum(axis=1).astype(np.int32))


def rerank(pairs: DataFrame, first: DataFrame, second: DataFrame, share: float) -> DataFrame:
    """Of candidate pairs ``a, b`` those with enough equal positions, and how many; ``first`` and ``second`` hold the
    vectors (cls, sig) of each side."""
    side = lambda vectors, x: vectors.select(F.col("cls").alias(x), F.col("sig").alias(f"s{x}"))
    return pairs.join(side(first, "a"), "a").join(side(second, "b"), "b").mapInPandas(_equal, "a long, b long, equal int").where(F.col("equal") >= least_equal(share))


class CellIndex:
    """A persisted index under a shared path: tables ``records`` (RECORDS) and ``cells`` (CELLS), each with a folder a
    version, and one empty file a version that was written to its end."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs("done")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(where)) if fs.exists(where) else []

    def _read(self, name: str, schema: StructType | str, versions: list[int]) -> DataFrame:
        parts = [f"{self.path}/{name}/{v:09d}" for v in versions]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, version: int) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/{version:09d}")
        return self._read(name, df.schema, [version])

    def vectors(self, versions: list[int] | None = None) -> DataFrame:
        """``cls, sig`` as stored: a vector that comes again is stored once a version."""
        return self._read("records", RECORDS, self.versions() if versions is None else versions).where("cls IS NOT NULL").select("cls", "sig")

    def add(self, records: DataFrame, version: int, share: float = SHARE, ask: bool = True, n: int | None = None) -> DataFrame | None:
        """Store ``records`` (rank, sha256, minhash) as ``version``, after probing them against the versions before it.

        Gives per record ``rank, exact, near``: whether its sha256, or a vector near its own, is stored or on a record
        here of a smaller rank; with ``ask`` off (history to begin with) nothing is asked. ``n``: how many records there
        are, which are else counted.
        """
        before = [v for v in self.versions() if v < version]
        own = self._write(packed(records), "records", version)
        firsts = own.where("cls IS NOT NULL").groupBy("cls").agg(F.min("rank").alias("rank"), F.any_value("sig").alias("sig"))
        made = self._write(cells(firsts), "cells", version)
        found = self._ask(own, firsts.select("cls", "sig"), made, before, share, own.count() if n is None else n) if ask else None
        fs, where = self._fs(f"done/{version:09d}")
        fs.create(where, True).close()
        return found

    def _ask(self, own: DataFrame, vectors: DataFrame, made: DataFrame, before: list[int], share: float, n: int) -> DataFrame:
        """The answers for a batch's ``n`` records (``own``), with their distinct ``vectors`` (cls, sig) and cells ``made``.

        Of the stored cells only those are moved that the batch meets. First each of them offers only one vector (a
        stored one, else the batch's earliest), which settles most vectors, among them all of a large group of near
        copies; the vectors still open then meet all earlier ones of their cells. What is met in no cell differs in
        more positions than allowed. No cell and no partner is left out for vectors that are still open.

        Each join of small tables is a table in the driver's memory on its way to the executors: ranks stand in the
        cells, and what came before a record is the least rank of a union. The driver is freed between the two passes.
        """
        stored = self.vectors(before)
        keys = n * sum(len(x) for x in np.array_split(np.arange(POSITIONS), GROUPS))
        hits = only(self._read("cells", CELLS, before), made.select("key"), ["key"], keys).select("key", F.col("cls").alias("b"), F.lit(_BEFORE).alias("rank_b"))
        met = materialize(hits.unionByName(made.select("key", F.col("cls").alias("b"), F.col("rank").alias("rank_b"))), free=False)
        asking = made.select("key", F.col("cls").alias("a"), F.col("rank").alias("rank_a"))
        first = met.groupBy("key").agg(F.min(F.struct("rank_b", "b")).alias("x")).select("key", "x.*")

        def near(other: DataFrame, asking: DataFrame, most: int | None = None) -> DataFrame:
            pairs = materialize(asking.join(other, "key").where("rank_b < rank_a").select("a", "b").distinct(), free=False)
            met_vectors = only(stored, pairs.select(F.col("b").alias("cls")), ["cls"], most).unionByName(vectors).dropDuplicates(["cls"])
            return rerank(pairs, vectors, met_vectors, share).select(F.col("a").alias("cls")).distinct()

        settled = materialize(near(first, asking, keys))
        late = near(met, asking.join(settled, asking["a"] == settled["cls"], "left_anti"))
        earlier = lambda column: own.where(F.col(column).isNotNull()).select(column, "rank")
        known = lambda df, column: df.select(column, F.lit(_BEFORE).alias("rank"))
        old = only(self._read("records", RECORDS, before).select("sha256"), own.where("sha256 IS NOT NULL").select("sha256"), ["sha256"], n)
        shas = earlier("sha256").unionByName(known(old, "sha256")).groupBy("sha256").agg(F.min("rank").alias("sha_first"))
        nears = earlier("cls").unionByName(known(settled, "cls")).unionByName(known(late, "cls")).groupBy("cls").agg(F.min("rank").alias("cls_first"))
        every = own.select("rank", "sha256", "cls").join(shas, "sha256", "left").join(nears, "cls", "left")
        out = every.select("rank", F.coalesce(F.col("sha_first") < F.col("rank"), F.lit(False)).alias("exact"), F.coalesce(F.col("cls_first") < F.col("rank"), F.lit(False)).alias("near"))
        out = materialize(out, free=False)
        discard(met, settled)
        return out


def classify(incoming: DataFrame, books: DataFrame, book_files: DataFrame, share: float = SHARE, path: str | None = None) -> DataFrame:
    """``item_id, match_kind`` (exact, near or new), one row per item; items are ordered by (batch_no, item_id).

    exact: the sha256 is in ``book_files`` or on an earlier item; near: enough positions equal those of a book or an
    earlier item. The index (under ``path``, else a new one in the shared folder) is begun with the books; then each
    batch in turn is probed against it and appended to it. Null sha256 and null or malformed vectors match nothing;
    repeated item rows count once; a null batch_no comes first.
    """
    spark = incoming.sparkSession
    index = CellIndex(spark, path or f"{shared_dir(spark).rstrip('/')}/quire/{uuid.uuid4().hex}")
    items = incoming.where("item_id IS NOT NULL").select("batch_no", F.col("item_id").alias("rank"), "sha256", "minhash").dropDuplicates(["rank"])
    items = materialize(items, free=False)
    none = F.lit(None)
    history = books.select("minhash", none.cast("string").alias("sha256")).unionByName(book_files.select(none.cast("array<long>").alias("minhash"), "sha256"))
    index.add(history.withColumn("rank", F.lit(0)), 0, share, ask=False)
    out = items.where("false").select("rank", F.lit(False).alias("exact"), F.lit(False).alias("near"))
    # one row a batch: there are as many as there were runs
    for k, row in enumerate(items.groupBy("batch_no").agg(F.count("*").alias("n")).orderBy("batch_no").collect(), 1):
        out = out.unionByName(index.add(items.where(F.col("batch_no").eqNullSafe(F.lit(row.batch_no))).drop("batch_no"), k, share, n=row.n))
        # else the driver holds the broadcasts and compiled plans of all batches
        release(spark)
    return out.select(F.col("rank").alias("item_id"), F.when(F.col("exact"), "exact").when(F.col("near"), "near").otherwise("new").alias("match_kind"))
