"""Near-duplicate texts by an LSH forest over MinHash signatures of five-word windows.

Every text gets minima of ``HASHES`` hash functions over its distinct windows. Each tree of the forest is a sorted
order of all texts by a sequence of these minima, hashed to one number; neighbours in the order whose common prefix
has the tree's depth are candidates. A region of an order with more than ``DENSE`` texts is too shallow there: all of
its texts are looked at again at the greatest depth there is, on their windows themselves (two texts of a similarity
of s share one of the rarest (1 - s) n + 1 windows of either, so that common boilerplate pairs nothing). A pair whose
regions are all dense is found there, without chance; any other pair by the order in which its region isn't dense.
Candidates are then compared exactly, on their windows, so the forest decides only what is compared.

Texts with the same words in the same order form a class and are treated once (``cls`` is a 64-bit hash of the
words); books with the same full signature likewise. Copies are expanded only where a query asks for pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.llm.hashing import mix, slices, windows, word_hashes
from quire.runtime import discard, materialize

HASHES = 96
#: Trees and their depth; no two trees share a hash function.
#: A pair of similarity s shares a region with probability 1 - (1 - s**least) ** trees: at 0.6, 0.9989 and 0.9996, at
#: 0.7, 0.99999 and more.
BLOCK_TREES, BLOCK_LEAST, BOOK_TREES, BOOK_LEAST = 28, 3, 32, 3
#: Most texts of a region whose pairs are compared as they stand; texts of a part of a hot window that are joined at a time.
DENSE = 64
#: The share of equal minima of two books may fall short of the threshold by SLACK, 3.6 standard deviations at 0.6
#: (missed with 0.0002).
SLACK = 0.18
THRESHOLD, MIN_WORDS, SIZE = 0.6, 40, 5
_CHUNK = 2048
_FACTORS = (np.random.default_rng(20240607).integers(1, 2**31, HASHES, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)


def signatures(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts with a window) x HASHES minima; ``at`` as made by ``windows`` with empty texts left out."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, HASHES), np.uint32)
    step = 512  # texts at a time, so that the products stay in the cache
    for i in range(0, len(at) - 1, step):
        j = min(i + step, len(at) - 1)
        part, starts = low[at[i] : at[j]], at[i:j] - at[i]
        for k in range(HASHES):
            out[i:j, k] = np.minimum.reduceat(part * _FACTORS[k], starts)
    return out


def tree_keys(sig: np.ndarray, trees: int, least: int) -> np.ndarray:
    """Per text and tree the 64-bit key of the prefix."""
    wide = sig.astype(np.uint64)
    near = np.empty((len(sig), trees), np.uint64)
    for t in range(trees):
        key = np.full(len(sig), t + 1, np.uint64)
        for level in range(least):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, t * least + level])
        near[:, t] = key
    return near


def _split(texts: list[str | None]):
    words, first, start, end = word_hashes(texts)
    grams, at = windows(words, first, SIZE)
    return words, first, grams, at


_SCAN = "book_id long, seq int, n_words int, cls long, near array<long>, head string, tail string, sig binary"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each block its word count and edge words, of each new class of at least MIN_WORDS words its tree keys,
    and of each book in the batch the minima over its blocks' windows (in a row without seq)."""
    for pdf in slices(batches):
        pdf = pdf.sort_values(["book_id", "seq"], kind="stable")
        texts = [t or "" for t in pdf["text"]]
        words, first, start, end = word_hashes(texts)
        grams, at = windows(words, first, SIZE)
        n = np.diff(first)
        has = np.diff(at) > 0
        where = np.append(at[:-1][has], at[-1])
        sig = signatures(grams, where)
        order = np.arange(len(words)) - np.repeat(first[:-1], n)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + (order.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), out=total[1:])
        cls = mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).astype(np.int64)
        place = np.cumsum(has) - 1
        long = n >= MIN_WORDS
        new = np.zeros(len(pdf), bool)
        at_long = np.flatnonzero(long)
        new[at_long[np.unique(cls[at_long], return_index=True)[1]]] = True
        near = tree_keys(sig[place[new]], BLOCK_TREES, BLOCK_LEAST)
        keys = np.full(len(pdf), None, object)
        for k, i in enumerate(np.flatnonzero(new)):
            keys[i] = near[k].view(np.int64)
        joined = "\n".join(t.lower() for t in texts)
        heads, tails = [], []
        for i in range(len(texts)):
            a, b = first[i], first[i + 1]
            heads.append(" ".join(joined[start[k] : end[k]] for k in range(a, min(a + SIZE - 1, b))))
            tails.append(" ".join(joined[start[k] : end[k]] for k in range(max(b - SIZE + 1, a), b)))
        yield pd.DataFrame({"book_id": pdf["book_id"].to_numpy(), "seq": pdf["seq"].to_numpy(), "n_words": n.astype(np.int32), "cls": pd.arrays.IntegerArray(cls, ~long), "near": keys, "head": heads, "tail": tails, "sig": None})
        if has.any():
            owner = pdf["book_id"].to_numpy()[has]
            cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            yield _book_rows(owner[cut], np.minimum.reduceat(sig, cut, axis=0))


def _book_rows(books: np.ndarray, sig: np.ndarray) -> pd.DataFrame:
    none = pd.Series([None] * len(books), dtype=object)
    return pd.DataFrame({"book_id": books, "seq": pd.arrays.IntegerArray(np.zeros(len(books), np.int32), np.ones(len(books), bool)), "n_words": np.zeros(len(books), np.int32), "cls": pd.arrays.IntegerArray(np.zeros(len(books), np.int64), np.ones(len(books), bool)), "near": none, "head": none, "tail": none, "sig": _packed(sig)})


def scan_blocks(blocks: DataFrame) -> DataFrame:
    """One tokenisation of all blocks, written to the shared folder; rows without book_id or seq are left out."""
    slim = blocks.where("book_id IS NOT NULL AND seq IS NOT NULL").select("book_id", F.col("seq").cast("int").alias("seq"), "text")
    return materialize(slim.mapInPandas(_scan, _SCAN))


def seams(scan: DataFrame) -> DataFrame:
    """``(book_id, text)``: the last four words before and the first four from each block on, in seq order.

    Every window that crosses blocks lies in one of these texts. Blocks are ordered in chunks of one book; only
    the outermost blocks of each chunk are then ordered over the whole book, so that a book with a large share of
    all rows is not ordered in one task.
    """
    lines = scan.where("seq IS NOT NULL AND n_words > 0").select("book_id", "seq", F.floor(F.col("seq") / _CHUNK).alias("chunk"), "head", "tail")
    lines = lines.repartition("book_id", "chunk").dropDuplicates(["book_id", "chunk", "seq"])

    def around(w) -> Column:
        before = F.slice(F.reverse(F.split(F.concat_ws(" ", *[F.lag("tail", k).over(w) for k in range(SIZE - 1, 0, -1)]), " ")), 1, SIZE - 1)
        after = F.slice(F.split(F.concat_ws(" ", "head", *[F.lead("head", k).over(w) for k in range(1, SIZE - 1)]), " "), 1, SIZE - 1)
        return F.concat_ws(" ", F.array_join(F.reverse(before), " "), F.array_join(after, " "))

    inner = W.partitionBy("book_id", "chunk").orderBy("seq")
    size = F.count("*").over(W.partitionBy("book_id", "chunk"))
    placed = lines.select("*", F.row_number().over(inner).alias("rn"), size.alias("cnt"), around(inner).alias("text"))
    outer = placed.where(f"rn < {SIZE} OR rn > cnt - {SIZE - 1}").select("*", around(W.partitionBy("book_id").orderBy("seq")).alias("wide"))
    return placed.where("rn > 1").select("book_id", "text").unionByName(outer.where("rn = 1").select("book_id", F.col("wide").alias("text")))


def _packed(sig: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.ascontiguousarray(sig, np.uint32)]


def _unpacked(sig: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sig), np.uint32).reshape(-1, HASHES)


def _least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Minima by book of rows sorted by book; the last book of a batch waits for the next."""
    book, sig = None, None
    for pdf in batches:
        if not len(pdf):
            continue
        owner, sigs = pdf["book_id"].to_numpy(), _unpacked(pdf["sig"])
        cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        owner, sigs = owner[cut], np.minimum.reduceat(sigs, cut, axis=0)
        if book is not None and owner[0] == book:
            sigs[0] = np.minimum(sigs[0], sig)
        elif book is not None:
            yield pd.DataFrame({"book_id": [book], "sig": [sig.tobytes()]})
        book, sig = owner[-1], sigs[-1].copy()
        yield pd.DataFrame({"book_id": owner[:-1], "sig": _packed(sigs[:-1])})
    if book is not None:
        yield pd.DataFrame({"book_id": [book], "sig": [sig.tobytes()]})


def _seam_sigs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf.sort_values("book_id", kind="stable")
        _, _, grams, at = _split(pdf["text"].tolist())
        has = np.diff(at) > 0
        if has.any():
            owner = pdf["book_id"].to_numpy()[has]
            cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sig = np.minimum.reduceat(signatures(grams, np.append(at[:-1][has], at[-1])), cut, axis=0)
            yield pd.DataFrame({"book_id": owner[cut], "sig": _packed(sig)})


def _book_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            near = tree_keys(_unpacked(pdf["sig"]), BOOK_TREES, BOOK_LEAST)
            yield pd.DataFrame({"id": pdf["id"], "near": list(near.view(np.int64))})


_ROWS, _PAIRS = pa.schema([("key", pa.int64()), ("id", pa.int64())]), pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id) of all orders. A key that is dense within a batch is sent on once, without an id, and its ids
    without a key: so a region that holds much of all rows never comes together."""
    for batch in batches:
        ids, near = batch.column(0).to_numpy(), batch.column(1)
        if not len(ids):
            continue
        keys = near.flatten().to_numpy()
        owner = np.repeat(ids, len(keys) // len(ids))
        values, kind, n = np.unique(keys, return_inverse=True, return_counts=True)
        hot = np.flatnonzero(n > DENSE)
        if len(hot):
            hot = hot[[len(np.unique(owner[kind == k])) > DENSE for k in hot]]
        if len(hot):
            dense = np.isin(kind, hot)
            gone = np.unique(owner[dense])
            yield pa.record_batch([pa.array(values[hot]), pa.nulls(len(hot), pa.int64())], schema=_ROWS)
            yield pa.record_batch([pa.nulls(len(gone), pa.int64()), pa.array(gone)], schema=_ROWS)
            keys, owner = keys[~dense], owner[~dense]
        yield pa.record_batch([pa.array(keys), pa.array(owner)], schema=_ROWS)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: pairs ``a < b`` of a region, and ids of a dense one (without b). Of a region that runs over
    a batch's end at most DENSE + 1 ids are kept."""
    keep_key, keep_id, keep_mark = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def distinct(key: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((mark, ids, key))
        key, ids, mark = key[order], ids[order], mark[order]
        new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (mark[1:] != mark[:-1]))
        return key[new], ids[new], mark[new]

    def pairs(key: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
        # most keys stand alone
        same = key[1:] == key[:-1]
        several = np.append(same, False) | np.append(False, same)
        if not several.any():
            return
        key, ids, mark = distinct(key[several], ids[several], mark[several])
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        dense = (size > DENSE) | np.logical_or.reduceat(mark, start)
        for n in np.unique(size[~dense]):
            if n > 1:
                rows = ids[start[~dense & (size == n)][:, None] + np.arange(n)]
                i, j = np.triu_indices(n, 1)
                yield pa.record_batch([pa.array(rows[:, i].ravel()), pa.array(rows[:, j].ravel())], schema=_PAIRS)
        gone = np.unique(ids[np.repeat(dense, size) & ~mark])
        if len(gone):
            yield pa.record_batch([pa.array(gone), pa.nulls(len(gone), pa.int64())], schema=_PAIRS)

    for batch in batches:
        key, ids = batch.column(0), batch.column(1)
        if key.null_count:
            loose = key.is_null().to_numpy(zero_copy_only=False)
            gone = np.unique(ids.fill_null(0).to_numpy()[loose])
            yield pa.record_batch([pa.array(gone), pa.nulls(len(gone), pa.int64())], schema=_PAIRS)
            keyed = batch.filter(pa.array(~loose))
            key, ids = keyed.column(0), keyed.column(1)
        mark = np.concatenate([keep_mark, ids.is_null().to_numpy(zero_copy_only=False)])
        key = np.concatenate([keep_key, key.to_numpy()])
        ids = np.concatenate([keep_id, ids.fill_null(0).to_numpy()])
        if not len(key):
            continue
        cut = np.searchsorted(key, key[-1])
        if cut:
            yield from pairs(key[:cut], ids[:cut], mark[:cut])
        key, ids, mark = distinct(key[cut:], ids[cut:], mark[cut:])
        if len(key) > DENSE or mark.any():
            gone = ids[~mark]
            yield pa.record_batch([pa.array(gone), pa.nulls(len(gone), pa.int64())], schema=_PAIRS)
            key, ids, mark = key[:1], np.zeros(1, np.int64), np.ones(1, bool)
        keep_key, keep_id, keep_mark = key, ids, mark
    if len(keep_key):
        yield from pairs(keep_key, keep_id, keep_mark)


def pairs_within(rows: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of ids that share a key. rows: key, id, distinct. The ids of a key are dealt into parts of
    about DENSE by hash and parts are joined with parts, so that no task holds a large group."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = rows.join(counts, "key").select("key", "id", F.ceil(F.col("n") / F.lit(DENSE)).cast("int").alias("parts"))
    dealt = materialize(dealt.select("key", "id", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("own"), F.sequence(F.lit(0), F.col("parts") - 1).alias("other")))
    left = dealt.select("key", F.col("id").alias("a"), F.col("own").alias("pa"), F.explode("other").alias("pb"))
    right = dealt.select("key", F.col("id").alias("b"), F.explode("other").alias("pa"), F.col("own").alias("pb"))
    found = materialize(left.join(right, ["key", "pa", "pb"]).where("a < b").select("a", "b").distinct())
    discard(dealt)
    return found


def by_rare_windows(windows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``a < b`` among which are all of at least ``threshold``. windows: id, w, distinct.

    Windows are ordered by how many texts have them. A pair of the threshold has one of the first
    n - ceil(threshold n) + 1 windows of both in common.
    """
    common = windows.groupBy("w").agg(F.count("*").alias("c"))
    sized = windows.join(common, "w").withColumn("n", F.count("*").over(W.partitionBy("id"))).withColumn("at", F.row_number().over(W.partitionBy("id").orderBy("c", "w")))
    first = sized.where((F.col("c") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1))
    return pairs_within(first.select(F.col("w").alias("key"), "id"))


def candidates(keys: DataFrame, windows_of: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``a < b`` of ids that are neighbours in some order, as a stored table. keys: id, near; ``windows_of`` gives
    the distinct windows (id, w) of a stored table of ids, for the texts of dense regions."""
    rows = keys.where("near IS NOT NULL").select("id", "near").mapInArrow(_orders, "key long, id long")
    rows = rows.repartition(F.coalesce("key", "id")).sortWithinPartitions("key")
    found = materialize(rows.mapInArrow(_neighbours, "a long, b long"))
    pairs = found.where("b IS NOT NULL")
    dense = materialize(found.where("b IS NULL").select(F.col("a").alias("id")).distinct())
    if not dense.isEmpty():
        pairs = pairs.unionByName(by_rare_windows(materialize(windows_of(dense)), threshold))
    pairs = materialize(pairs.distinct())
    discard(found)
    return pairs


#: Keys that may be broadcast; beyond, a fixed bitmap decides which rows go on to an ordinary join.
BROADCAST_KEYS, _BITS = 500_000, 1 << 26


def only(rows: DataFrame, keys: DataFrame, on: list[str], most: int | None = None) -> DataFrame:
    """Rows whose key is in ``keys`` (a stored table of at most ``most`` rows, which are else counted): a broadcast
    semi-join while the keys are few. Beyond, most
    other rows are first dropped by a bitmap of _BITS bits over the keys' hashes, which misses no member, so that
    only the rest is shuffled."""
    if (keys.count() if most is None else most) <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys.select(on)), on, "left_semi")
    at = F.pmod(F.xxhash64(*on), F.lit(_BITS))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(_BITS, bool)
        for pdf in batches:
            bits[pdf["at"].to_numpy()] = True
        yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})

    total = np.zeros(_BITS // 8, np.uint8)
    for row in keys.select(at.alias("at")).coalesce(4).mapInPandas(fill, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    bits = rows.sparkSession.sparkContext.broadcast(total)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = pdf.pop("_at").to_numpy()
            yield pdf[(bits.value[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1 > 0]

    likely = rows.withColumn("_at", at).mapInPandas(keep, rows.schema)
    return likely.join(keys.select(on), on, "left_semi")


def book_links(scan: DataFrame, blocks: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes of books ``(book_id, rep)`` and links ``(a, b)`` between representatives of at least ``threshold``.

    A book's text is its blocks in seq order; books without a window are in no class.
    """
    edge = materialize(seams(scan))
    parts = scan.where("sig IS NOT NULL").select("book_id", "sig").unionByName(edge.mapInPandas(_seam_sigs, "book_id long, sig binary"))
    books = parts.repartition("book_id").sortWithinPartitions("book_id").mapInPandas(_least, "book_id long, sig binary")
    books = materialize(books.select("book_id", F.xxhash64("sig").alias("cls"), "sig"))
    reps = books.groupBy("cls").agg(F.min(F.struct("book_id", "sig")).alias("x")).select("cls", F.col("x.book_id").alias("id"), "x.sig")
    reps = materialize(reps)
    classes = materialize(books.select("book_id", "cls").join(reps.select("cls", F.col("id").alias("rep")), "cls").select("book_id", "rep"))
    texts = blocks.where("book_id IS NOT NULL AND seq IS NOT NULL").select("book_id", "text").unionByName(edge)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            _, _, g, at = _split(pdf["text"].tolist())
            yield pd.DataFrame({"id": np.repeat(pdf["book_id"].to_numpy(), np.diff(at)), "w": g.astype(np.int64)}).drop_duplicates()

    def windows_of(ids: DataFrame) -> DataFrame:
        return only(texts, ids.select(F.col("id").alias("book_id")), ["book_id"]).mapInPandas(grams, "id long, w long").distinct()

    pairs_of = candidates(reps.select("id", "sig").mapInPandas(_book_keys, "id long, near array<long>"), windows_of, threshold)

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                same = (_unpacked(pdf["sa"]) == _unpacked(pdf["sb"])).mean(axis=1)
                yield pdf.loc[same >= threshold - SLACK, ["a", "b"]]

    pairs = pairs_of.join(reps.selectExpr("id AS a", "sig AS sa"), "a").join(reps.selectExpr("id AS b", "sig AS sb"), "b")
    pairs = materialize(pairs.mapInPandas(alike, "a long, b long"))
    have = materialize(windows_of(pairs.selectExpr("explode(array(a, b)) AS id").distinct()))
    counts = have.groupBy("id").agg(F.count("*").alias("n"))
    sized = pairs.join(counts.selectExpr("id AS a", "n AS na"), "a").join(counts.selectExpr("id AS b", "n AS nb"), "b").where(f"least(na, nb) >= {threshold} * greatest(na, nb)")
    common = sized.join(have.selectExpr("id AS a", "w"), "a").join(have.selectExpr("id AS b", "w"), ["b", "w"]).groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    # compared in whole numbers: c / (na + nb - c) >= threshold
    links = common.where(F.col("c") * 1000 >= F.lit(round(threshold * 1000)) * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")
    links = materialize(links)
    discard(edge, books, reps, pairs_of, pairs, have)
    return classes, links


def _expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of members of linked classes and of members of one class; members: rep and the member's columns in m."""
    a, b = members.select(F.col("rep").alias("a"), F.col("m").alias("ma")), members.select(F.col("rep").alias("b"), F.col("m").alias("mb"))
    across = links.join(a, "a").join(b, "b").select("ma", "mb")
    within = a.join(b, a.a == b.b).where("ma < mb").select("ma", "mb")
    return across.union(within).select(F.least("ma", "mb").alias("x"), F.greatest("ma", "mb").alias("y"))


def book_pairs(scan: DataFrame, blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``book_a < book_b`` of books of at least ``threshold``."""
    classes, links = book_links(scan, blocks, threshold)
    return _expand(links, classes.select("rep", F.struct("book_id").alias("m"))).select(F.col("x.book_id").alias("book_a"), F.col("y.book_id").alias("book_b"))


def block_links(scan: DataFrame, blocks: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes of blocks of at least MIN_WORDS words ``(cls, book_id, seq)`` and links ``(a, b)`` between classes."""
    members = scan.where("cls IS NOT NULL").select("cls", "book_id", "seq").distinct()
    texts = blocks.where("book_id IS NOT NULL AND seq IS NOT NULL").select("book_id", F.col("seq").cast("int").alias("seq"), "text")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            _, _, g, at = _split(pdf["text"].tolist())
            yield pd.DataFrame({"book_id": pdf["book_id"], "seq": pdf["seq"], "w": [np.unique(g[i:j]).astype(np.int64) for i, j in zip(at[:-1], at[1:])]})

    def windows(ids: DataFrame) -> DataFrame:
        """``cls, w``: the distinct windows of classes (id), as one array each, read at one of the places of each."""
        spots = members.join(ids.select(F.col("id").alias("cls")), "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("book_id", "seq")).alias("x"))
        spots = materialize(spots.select("cls", "x.book_id", "x.seq"))
        return only(texts, spots, ["book_id", "seq"]).mapInPandas(grams, "book_id long, seq int, w array<long>").join(spots, ["book_id", "seq"]).dropDuplicates(["cls"]).select("cls", "w")

    keys = scan.where("near IS NOT NULL").select(F.col("cls").alias("id"), "near")
    pairs = candidates(keys, lambda ids: windows(ids).select(F.col("cls").alias("id"), F.explode("w").alias("w")), threshold)
    have = materialize(windows(pairs.selectExpr("explode(array(a, b)) AS id").distinct()))
    both = pairs.join(have.selectExpr("cls AS a", "w AS wa"), "a").join(have.selectExpr("cls AS b", "w AS wb"), "b")
    c, na, nb = F.size(F.array_intersect("wa", "wb")), F.size("wa"), F.size("wb")
    links = both.select("a", "b", c.alias("c"), na.alias("na"), nb.alias("nb")).where(F.col("c") * 1000 >= F.lit(round(threshold * 1000)) * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")
    links = materialize(links)
    discard(pairs, have)
    return members, links


def found_pairs(blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``rec_table, book_a, seq_a, book_b, seq_b``: all pairs of books, and of blocks of different books that are
    not such a pair, whose similarity reaches ``threshold``. Null texts count as empty; repeated rows count once;
    an empty table gives no pair."""
    scan = scan_blocks(blocks)
    books = materialize(book_pairs(scan, blocks, threshold))
    members, links = block_links(scan, blocks, threshold)
    pairs = _expand(links, members.select(F.col("cls").alias("rep"), F.struct("book_id", "seq").alias("m")))
    pairs = pairs.select(F.col("x.book_id").alias("book_a"), F.col("x.seq").alias("seq_a"), F.col("y.book_id").alias("book_b"), F.col("y.seq").alias("seq_b")).where("book_a <> book_b")
    pairs = pairs.join(books, ["book_a", "book_b"], "left_anti")
    minus = F.lit(-1).cast("int")
    of_books = books.select(F.lit("books").alias("rec_table"), F.col("book_a"), minus.alias("seq_a"), F.col("book_b"), minus.alias("seq_b"))
    return of_books.unionByName(pairs.select(F.lit("blocks").alias("rec_table"), "book_a", "seq_a", "book_b", "seq_b"))


def block_classes(blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per block of at least MIN_WORDS words: its near-duplicate class (the least class hash of its
    connected component), and how many other texts its own text is linked to."""
    from quire.operators.components import connected_components

    members, links = block_links(scan_blocks(blocks), blocks, threshold)
    group = connected_components(links)
    degree = links.selectExpr("explode(array(a, b)) AS cls").groupBy("cls").agg(F.count("*").alias("links"))
    out = members.join(group.select(F.col("id").alias("cls"), "component"), "cls", "left").join(degree, "cls", "left")
    return out.select("book_id", "seq", F.coalesce("component", "cls").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
