"""Documents into containers of fixed capacity, by vector best fit.

A container has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths), of which
it may take ATTENTION of that of one full piece; a piece that is dearer by itself stands alone. Items go in decreasing
size into the open container that fits under every constraint and is left with the smallest weighted residual norm, or
has the largest weighted dot product of item and residual. Documents beyond the capacity are cut into full pieces and
a rest; nothing else is ever cut.

Rows are dealt by hash of their document and number into lots of about LOT items that are packed side by side,
whatever the table's layout; a lot ends with a few containers that aren't full, a share of about one in LOT, while the
fit inside it hardly gains from more items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.llm.tokens import TOKENIZER, token_sizes
from quire.runtime import materialize

LOT, MOST_KINDS = 4096, 1000
#: Most documents of a container, as one for so many tokens of capacity; weights of tokens, documents and attention.
TOKENS_PER_DOCUMENT, WEIGHTS = 16, (1.0, 0.1, 0.1)
#: Most attention cost of a container of several pieces, as a share of the squared capacity.
ATTENTION = 0.9
#: Rows of one document and size that are numbered in one step.
_STEP = 10_000


def best_fit(sizes: np.ndarray, capacity: int, max_documents: int, max_attention: float, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Container number of each item. Sizes are at most ``capacity``; an item that is over ``max_attention`` by itself
    gets a container of its own, which is closed at once."""
    scale = np.array([capacity, max_documents, max_attention], float)
    weight = np.array(weights, float)
    order = np.argsort(-sizes, kind="stable")
    free = np.empty((1024, 3))
    name = np.empty(1024, np.int64)
    open_, made = 0, 0
    out = np.empty(len(sizes), np.int64)
    for i in order:
        need = np.array([sizes[i], 1.0, float(sizes[i]) ** 2]) / scale
        r = free[:open_]
        fits = np.flatnonzero((r >= need - 1e-12).all(axis=1)) if need[2] <= 1 else ()
        if len(fits):
            left = r[fits]
            score = -(weight * (left - need) ** 2).sum(axis=1) if rule == "norm" else (weight * left * need).sum(axis=1)
            k = fits[score.argmax()]
        else:
            if open_ == len(free):
                free, name = np.concatenate([free, np.empty_like(free)]), np.concatenate([name, np.empty_like(name)])
            k = open_
            free[k], name[k] = 1.0, made
            open_, made = open_ + 1, made + 1
        free[k] -= need
        out[i] = name[k]
        if sizes[i] and free[k, 0] * capacity < 0.5 or free[k, 1] * max_documents < 0.5 or need[2] > 1:  # full: closed
            open_ -= 1
            free[k], name[k] = free[open_], name[open_]
    return out


def pack(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER, rule: str = "norm", attention: float = ATTENTION) -> DataFrame:
    """One row per piece: ``container_name, container_id, doc_id, piece, tokens, unused`` (of its container).

    Null and empty texts have no tokens and take a document's place only. Rows without doc_id are packed too.
    Containers without a name or a positive capacity are left out. A repeated document row is packed as often.
    """
    sizes = materialize(token_sizes(documents, ["doc_id"], tokenizer))
    lots = max(1, round(sizes.count() / LOT))
    kinds = containers.where("container_name IS NOT NULL AND capacity_tokens > 0").select("container_name", F.col("capacity_tokens").cast("long").alias("capacity")).dropDuplicates(["container_name"])
    # rows of one document and size are alike; they are counted, and numbered in steps, however many they are
    alike = sizes.groupBy("doc_id", "tokens").agg(F.count("*").alias("n"))
    steps = alike.select("doc_id", "tokens", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _STEP))).alias("step")).repartition("doc_id", "tokens", "step")
    numbered = steps.select("doc_id", "tokens", F.explode(F.sequence(F.col("step") * _STEP, F.least("n", (F.col("step") + 1) * _STEP) - 1)).alias("number"))
    salted = numbered.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id", "tokens", "number"), F.lit(lots)).alias("lot"))
    # every document goes once into each kind of container: the few kinds are laid out as one array per row
    listed = [(r.container_name, r.capacity) for r in kinds.limit(MOST_KINDS + 1).collect()]
    if len(listed) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    if not listed:
        listed = [(None, 1)]
    options = F.array(*[F.struct(F.lit(a).cast("string").alias("container_name"), F.lit(b).cast("long").alias("capacity")) for a, b in listed])
    each = salted.select("*", F.explode(options).alias("k")).select("doc_id", "tokens", "lot", "k.*").where("container_name IS NOT NULL")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, lot = key
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "tokens"], kind="stable")
        n = pdf["tokens"].to_numpy()
        pieces = np.maximum(-(-n // capacity), 1)
        owner = np.repeat(np.arange(len(pdf)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[owner] - number * capacity, capacity)
        where = best_fit(size, capacity, max(1, capacity // TOKENS_PER_DOCUMENT), attention * float(capacity) ** 2, rule)
        unused = capacity - np.bincount(where, weights=size).astype(np.int64)
        ids = pdf["doc_id"].to_numpy()[owner]
        return pd.DataFrame({"container_name": name, "container_id": [f"{lot}-{w}" for w in where], "doc_id": ids, "piece": number.astype(np.int32), "tokens": size, "unused": unused[where]})

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"container_name string, container_id string, doc_id {kind}, piece int, tokens long, unused long"
    return each.groupBy("container_name", "lot").applyInPandas(run, schema)


def unused_space(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind of container: containers used, tokens in them, unused tokens and their share."""
    each = packed.groupBy("container_name", "container_id").agg(F.sum("tokens").alias("tokens"), F.min("unused").alias("unused"))
    made = each.groupBy("container_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused"))
    return made.select("*", F.round(F.col("unused") / (F.col("tokens") + F.col("unused")), 6).alias("unused_share"))
