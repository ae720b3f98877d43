"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked to the sources' target shares and to the corpus's own
language and topic shares, never beyond a source's cap on repeats. Documents are then sampled by calibrated
probabilities: a document of weight w is taken floor(w) times, and once more if its hash falls below the fraction,
stretched per source so that the source's total meets its target.

The total is the largest at which no source needs more than its cap. A topic is a collection that holds at least one in
TOPICS of all tokens; the smaller ones are one topic together. So the cells are bounded: at most MOST_SOURCES sources
of the target table, the languages of the label table and one for all others, and TOPICS + 1 topics.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from quire.llm.langid import ISO3, norm_label
from quire.llm.tokens import TOKENIZER, token_sizes
from quire.runtime import materialize

TOPICS, ROUNDS, GRID, MOST_SOURCES = 256, 200, 4096, 10_000


def rake(cells: pd.DataFrame, share: dict[str, float], cap: dict[str, int]) -> np.ndarray:
    """Weight of each cell (columns source, lang, topic, tokens). The source totals are met last and exactly, as far as
    the caps allow; language and topic totals as nearly as the caps and the sources leave them free."""
    tokens = cells["tokens"].to_numpy(float)
    src, names = pd.factorize(cells["source"])
    lang, _ = pd.factorize(cells["lang"])
    topic, _ = pd.factorize(cells["topic"])
    most = np.array([cap[s] for s in names], float)[src]
    have = np.bincount(src, tokens)
    want = np.array([share[s] for s in names])
    limit = np.array([cap[s] for s in names], float)
    total = float(np.min(np.where(want > 0, limit * have / np.maximum(want, 1e-300), np.inf))) * want.sum()
    goal = want / want.sum() * total
    margins = [(lang, np.bincount(lang, tokens) / tokens.sum() * total), (topic, np.bincount(topic, tokens) / tokens.sum() * total)]
    w = (goal / have)[src]
    for _ in range(ROUNDS):
        before = w
        for at, target in margins:
            now = np.bincount(at, w * tokens)
            w = np.minimum(w * np.divide(target, now, out=np.ones_like(now), where=now > 0)[at], most)
        for _ in range(20):  # the rest of a capped source goes to its other cells
            now = np.bincount(src, w * tokens)
            ratio = np.divide(goal, now, out=np.ones_like(now), where=now > 0)
            w = np.minimum(w * ratio[src], most)
            if np.allclose(np.bincount(src, w * tokens), goal, rtol=1e-9):
                break
        if np.abs(w - before).max() < 1e-9:
            break
    return w


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The chosen documents ``doc_id, source, tokens, copies`` (copies >= 1) and the report by source.

    Sources without a target, and rows without a source or any token, aren't used; sources without a token are
    reported with nothing and the others share their part. An empty table gives an empty mix.
    """
    spark = documents.sparkSession
    goals = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").dropDuplicates(["source"]).limit(MOST_SOURCES + 1).toPandas()
    if len(goals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    label = norm_label(F.col("lang"))
    lang = F.when(label.isin(*ISO3), label).otherwise("xx").alias("lang")
    sized = materialize(token_sizes(documents.select("doc_id", "source", "text", lang, "collection"), ["doc_id", "source", "lang", "collection"], tokenizer))
    of_topic = sized.groupBy("collection").agg(F.sum("tokens").alias("t"))
    every = of_topic.agg(F.sum("t")).first()[0] or 0
    large = [r.collection for r in of_topic.where((F.col("collection").isNotNull()) & (F.col("t") * TOPICS >= F.lit(every))).select("collection").collect()]
    topic = F.when(F.col("collection").isin(large), F.col("collection")).otherwise("") if large else F.lit("")
    sized = sized.withColumn("topic", topic).drop("collection")
    usable = sized.where(F.col("source").isin([str(x) for x in goals["source"]]) & (F.col("tokens") > 0)) if len(goals) else sized.where("false")
    cells = usable.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).toPandas()
    share = {s: float(x) for s, x in zip(goals["source"], goals["target_share"])}
    cap = {s: int(x) for s, x in zip(goals["source"], goals["max_repeats"])}
    cells["weight"] = rake(cells, share, cap) if len(cells) else np.zeros(0)
    cells["weight"] = cells["weight"].round(9)
    weights = spark.createDataFrame(cells[["source", "lang", "topic", "weight"]], "source string, lang string, topic string, weight double")
    u = (F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    drawn = usable.join(F.broadcast(weights), ["source", "lang", "topic"]).select("doc_id", "source", "tokens", "weight", F.floor("weight").alias("whole"), (F.col("weight") - F.floor("weight")).alias("part"), u.alias("u"))
    # a document gets one copy more if u / part is below the source's stretch, which is read off a histogram by source
    ratio = F.when(F.col("part") > 0, F.col("u") / F.col("part"))
    bucket = F.least(F.floor(F.log1p(ratio) * GRID), F.lit(40 * GRID)).cast("int")
    histogram = drawn.groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * (F.col("weight") - F.col("whole"))).alias("need"))
    by = W.partitionBy("source")
    steps = histogram.withColumn("need", F.sum("need").over(by)).where("bucket IS NOT NULL").withColumn("reached", F.sum("tokens").over(by.orderBy("bucket")))
    # buckets taken whole; the one that passes the need only if that is nearer
    before = F.col("reached") - F.col("tokens")
    taken = (F.col("reached") <= F.col("need")) | (before < F.col("need")) & (F.col("reached") - F.col("need") < F.col("need") - before)
    limits = steps.where(taken).groupBy("source").agg(F.max("bucket").alias("last"))
    copies = F.col("whole") + F.when(bucket <= F.col("last"), 1).otherwise(0)
    # at most one row a source of the target table
    chosen = drawn.join(F.broadcast(limits), "source", "left").select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")
    chosen = materialize(chosen)
    used = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    stock = usable.groupBy("source").agg(F.sum("tokens").alias("tokens_available"))
    goal_table = targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    report = goal_table.join(stock, "source", "left").join(used, "source", "left")
    every = used.agg(F.sum("tokens_used")).first()[0] or 0
    report = report.na.fill(0, ["tokens_available", "documents", "copies", "tokens_used", "most_copies"])
    return chosen, report.select("*", F.round(F.col("tokens_used") / F.lit(float(max(every, 1))), 6).alias("actual_share"))
