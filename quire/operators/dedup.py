"""Works that are editions of one another, by MinHash signatures and by shingles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.functions import text as T
from quire.operators.components import connected_components
from quire.runtime import materialize

PERMUTATIONS, SHARE, LENGTH_RATIO, LEAST_WORDS = 128, 0.6, 0.5, 500
#: Which format's record of a work is kept.
FORMAT_ORDER = ("epub", "pdf", "fb2", "html", "txt", "mobi", "doc")
_MERSENNE = (1 << 61) - 1


def signatures(texts: DataFrame, key: str, text: str = "text", size: int = 5) -> DataFrame:
    """``key, minhash``: PERMUTATIONS 32-bit minima over the distinct word windows; null for texts without one."""
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 31, PERMUTATIONS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 62, PERMUTATIONS, dtype=np.int64).astype(np.uint64)

    def run(batches):
        for pdf in batches:
            out = []
            for h in pdf["h"]:
                x = np.asarray(h, np.int64).astype(np.uint64)
                out.append(((x[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1).astype(np.int64) if len(x) else None)
            yield pd.DataFrame({key: pdf[key], "minhash": pd.Series(out, dtype=object)})

    hashed = texts.select(key, F.transform(T.shingles(F.coalesce(F.col(text), F.lit("")), size), lambda s: F.xxhash64(s)).alias("h"))
    return hashed.mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, minhash array<long>")


def eligible(books: DataFrame) -> DataFrame:
    """Works whose signature can be trusted: text of some length that wasn't recognised from pictures."""
    return books.where("minhash IS NOT NULL AND status = 'extracted' AND needs_ocr = false").where(F.col("word_count") >= LEAST_WORDS)


def similar_pairs(books: DataFrame, share: float = SHARE, new_ids: DataFrame | None = None, on: str = "id") -> DataFrame:
    """``a < b, equal``: pairs whose signatures agree in at least ``share`` of the positions and whose lengths differ by
    no more than half; with ``new_ids`` only pairs with at least one of them.

    No pair is missed: the positions form 26 groups of 4 or 5, and two signatures that differ in fewer than 52
    positions differ in at most one position of some group, so they share the rest of that group. Equal signatures are
    compared once; their works are paired at the end.
    """
    need = int(np.ceil(round(share * PERMUTATIONS, 6)))
    parts = np.array_split(np.arange(PERMUTATIONS), 26)
    if PERMUTATIONS - need >= 2 * len(parts):
        raise ValueError("the share is too low for the groups")
    ok = books.where(F.size("minhash") == PERMUTATIONS).select(F.col(on).alias("id"), "minhash", "word_count", F.xxhash64("minhash").alias("cls"))
    reps = materialize(ok.groupBy("cls").agg(F.any_value("minhash").alias("minhash")))
    chosen = [[int(p) for i, p in enumerate(part) if i != j] for part in parts for j in range(len(part))]
    places = F.array(*[F.array(*[F.lit(p) for p in (c + c)[:4]]) for c in chosen])  # of three positions the first twice
    keys = F.transform(places, lambda p, k: F.xxhash64(k, *[F.get("minhash", F.get(p, F.lit(i))) for i in range(4)]))
    cells = materialize(reps.select("cls", F.explode(keys).alias("key")))
    pairs = cells.alias("a").join(cells.alias("b"), "key").where("a.cls < b.cls").select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()
    equal = F.aggregate(F.zip_with("ma", "mb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    side = lambda x: reps.select(F.col("cls").alias(x), F.col("minhash").alias(f"m{x}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", equal.alias("equal")).where(F.col("equal") >= need)
    same = reps.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(PERMUTATIONS).alias("equal"))
    of = lambda x, c: ok.select(F.col("cls").alias(x), F.col("id").alias(f"i{c}"), F.col("word_count").alias(f"w{c}"))
    full = links.unionByName(same).join(of("a", "1"), "a").join(of("b", "2"), "b").where("i1 <> i2 AND (a <> b OR i1 < i2)")
    full = full.where((F.least("w1", "w2") >= LENGTH_RATIO * F.greatest("w1", "w2")))
    out = full.select(F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b"), "equal")
    if new_ids is not None:
        new = new_ids.toDF("id").distinct().withColumn("new", F.lit(True))
        out = out.join(new.select(F.col("id").alias("a"), F.col("new").alias("na")), "a", "left").join(new.select(F.col("id").alias("b"), F.col("new").alias("nb")), "b", "left").where("na OR nb").select("a", "b", "equal")
    return out


def merges(books: DataFrame, pairs: DataFrame, on: str = "id") -> DataFrame:
    """``canonical, alternate`` of every connected group: the best format, then the most words, then the smallest id."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in FORMAT_ORDER]), F.col("source_format")), F.lit(0))
    rank = F.when(order == 0, 9).otherwise(order - 1)
    group = materialize(connected_components(pairs))
    members = group.join(books.select(F.col(on).alias("id"), rank.alias("r"), (-F.col("word_count")).alias("w")), "id")
    best = members.groupBy("component").agg(F.min(F.struct("r", "w", "id")).alias("x")).select("component", F.col("x.id").alias("canonical"))
    return members.join(best, "component").where("id <> canonical").select("canonical", F.col("id").alias("alternate"))


def jaccard_pairs(texts: DataFrame, key: str, text: str = "text", threshold: float = 0.8, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Classes of texts with equal windows ``key, rep`` and pairs ``a < b, common, jaccard`` of representatives whose
    windows reach ``threshold``; texts without a window have no class.

    An exact prefix join: windows are ordered by how many texts hold them, rare ones first; two sets can only reach
    the threshold if they share one of their first n - ceil(threshold * n) + 1 windows.
    """
    sets = texts.select(key, F.array_sort(F.transform(T.shingles(F.coalesce(F.col(text), F.lit("")), size), lambda s: F.xxhash64(s))).alias("s")).where(F.size("s") > 0)
    each = materialize(sets.withColumn("cls", F.xxhash64("s")))
    reps = materialize(each.groupBy("cls").agg(F.min(key).alias("rep"), F.any_value("s").alias("s")))
    classes = each.select(key, "cls").join(reps.select("cls", "rep"), "cls").select(key, "rep")
    flat = reps.select("rep", F.size("s").alias("n"), F.explode("s").alias("w"))
    freq = flat.groupBy("w").agg(F.count("*").alias("df")).where("df > 1")
    # windows of one text only come first in the order and can't be shared
    ranked = flat.join(freq, "w").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("x"))
    single = F.col("n") - F.size("x")
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int") + 1 - single
    prefix = ranked.where(keep > 0).select("rep", "n", F.explode(F.slice("x", F.lit(1), F.greatest(keep, F.lit(1)))).alias("y")).select("rep", "n", F.col("y.w").alias("w"))
    prefix = materialize(prefix)
    pairs = prefix.alias("a").join(prefix.alias("b"), "w").where(F.expr(f"a.rep < b.rep AND least(a.n, b.n) >= {threshold} * greatest(a.n, b.n)")).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("s").alias(f"s{x}"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("all"))
    found = both.where(F.col("common") * 1000 >= F.lit(round(threshold * 1000)) * F.col("all"))
    return classes, found.select("a", "b", "common", F.round(F.col("common") / F.col("all"), 6).alias("jaccard"))
