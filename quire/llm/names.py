"""Variant spellings of one person's or organisation's name.

Names become vectors of the character n-grams of their words, and of the words that these may be typing errors of (a far
commoner word one edit away), weighted by inverse document frequency. A sparse cosine join finds all pairs
of at least JOIN (in vectors of 3- to 5-grams by the third power of the weight, so that common endings count for
little): of each vector only the rarest n-grams are indexed, as many as are needed so that the rest alone cannot reach
JOIN, and two vectors meet only where what is left of both can reach it. There is no best-n cut, so no partner is lost. Pairs whose words contradict each other count as not similar;
then average linkage groups what is left, contradictions included in the averages: a few errors don't part a group,
and a chain of likenesses doesn't join two.

The linkage is worked out on the edges themselves, in rounds that join all pairs of groups that are each other's
nearest; for average linkage that gives the groups of the one-by-one order. No component is ever collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.llm.hashing import mix
from quire.llm.neardup import DENSE
from quire.runtime import discard, materialize

#: Least cosine of the join, least average cosine of a group, spellings from which on an n-gram counts as no rarer, slots
#: of the n-grams (they share slots by hash).
JOIN, LINK, RARE, SLOTS = 0.33, 0.25, 8, 1 << 20
#: Words as alike as this share of their pairs of letters may be one word with errors.
ALIKE = 0.75

#: Strings that name nobody, and words that are no part of a name.
FILLERS = ("", "-", "--", "?", "n/a", "na", "none", "null", "nil", "unknown", "unknown author", "author unknown", "author", "anonymous", "anon", "anon.", "various", "various authors", "various artists", "admin", "administrator", "user", "owner", "root", "default", "test", "unbekannt", "anonyme", "anonimo", "anónimo", "untitled", "n.n.", "nn", "s.n.", "sn")
HONORIFICS = ("dr", "prof", "rev", "mr", "mrs", "ms", "sir", "st", "fr", "by", "the", "von", "hon")
LINKING = ("of", "at", "for", "de", "del", "der", "die", "das", "du", "des", "la", "le", "fur", "f", "and", "und", "et", "y", "e", "di", "da", "do")
#: Short forms of given names, folded to plain letters.
SHORT = {
    "bia": "beatriz", "tavi": "octavia", "ben": "benjamin", "nell": "helene helen eleanor", "ros": "rosalind", "roz": "rosalind", "hattie": "harriet", "lottie": "charlotte",
    "hans": "johannes", "tom": "thomas", "tommy": "thomas", "mina": "wilhelmina", "katya": "ekaterina", "tina": "valentina christina", "pepe": "jose", "paddy": "patrick", "pat": "patrick",
    "josie": "josephine", "jo": "josephine", "beppe": "giuseppe", "ted": "theodore edward", "theo": "theodore", "greg": "gregory", "paco": "francisco", "pancho": "francisco", "dima": "dmitri",
    "ulla": "ursula", "fritz": "friedrich", "kolya": "nikolai", "fanch": "francois", "kathy": "katherine", "kate": "katherine", "katie": "katherine", "kit": "katherine", "mari": "maria",
    "renzo": "lorenzo", "betty": "elizabeth", "liz": "elizabeth", "beth": "elizabeth", "lizzie": "elizabeth", "ned": "edward", "ed": "edward", "eddie": "edward", "rob": "robert",
    "bob": "robert", "alex": "alexander", "sandy": "alexander", "sasha": "alexander", "will": "william wilhelmina", "bill": "william", "billy": "william", "maggie": "margaret",
    "peggy": "margaret", "meg": "margaret", "dick": "richard", "jim": "james", "jack": "john", "harry": "henry harold", "nick": "nicholas", "tony": "anthony", "mike": "michael",
    "sepp": "josef", "xaver": "franz", "lola": "dolores", "nacho": "ignacio", "gianni": "giovanni", "vanya": "ivan", "misha": "mikhail", "volodya": "vladimir",
}
_PLAIN = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
_WORD = re.compile(r"([^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))*)(\.?)")


@lru_cache(maxsize=100_000)
def parse(name: str) -> tuple[tuple[tuple[str, bool], ...], int]:
    """Words of a name folded to plain lower case, each with whether it is cut short, and the place of the surname."""
    name = re.sub(r"\(\s*(author|ed\.?|editor)\s*\)", " ", name, flags=re.I)
    comma = name.find(",")
    out, last_before = [], []
    for m in _WORD.finditer(name):
        word = "".join(c for c in unicodedata.normalize("NFKD", m[1].lower().translate(_PLAIN)) if not unicodedata.combining(c))
        if word in HONORIFICS or word in LINKING and len(word) > 1:
            continue
        if 0 <= m.start() < comma:
            last_before.append(len(out))
        out.append((word, bool(m[2]) or len(word) == 1))
    whole = [k for k, (_, cut) in enumerate(out) if not cut]
    surname = last_before[0] if len(last_before) == 1 else whole[-1] if whole else len(out) - 1
    return tuple(out), surname


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def canonical(name: str) -> str:
    """The words of a name, folded, the surname last; one that is cut short ends in a point."""
    words, k = parse(name)
    return " ".join(w + "." * cut for w, cut in (*words[:k], *words[k + 1 :], *words[k : k + 1]))


def _words(canonical: str) -> list[tuple[str, bool]]:
    return [(w.rstrip("."), w.endswith(".")) for w in canonical.split(" ")]


def _alike(a: str, b: str) -> float:
    """The share of common pairs of letters of two words."""
    pairs = [{p[i : i + 2] for i in range(len(p) - 1)} for p in (f" {a} ", f" {b} ")]
    return 2 * len(pairs[0] & pairs[1]) / (len(pairs[0]) + len(pairs[1]))


@lru_cache(maxsize=200_000)
def _word_fits(a: str, cut_a: bool, b: str, cut_b: bool) -> bool:
    """Whether two words may be one: equal, one the beginning of the other, one with errors of the other, or short forms."""
    if a == b or cut_a and b.startswith(a) or cut_b and a.startswith(b):
        return True
    forms_a, forms_b = SHORT.get(a, a).split(), SHORT.get(b, b).split()
    if set(forms_a) & set(forms_b) or cut_a and any(x.startswith(a) for x in forms_b) or cut_b and any(x.startswith(b) for x in forms_a):
        return True
    shorter, longer = sorted((a, b), key=len)
    if len(shorter) > 5 and longer.startswith(shorter) or len(shorter) > 3 and (one_edit(a, b) or _alike(a, b) >= ALIKE):
        return True
    # a short word may be a short form that no list has
    return not cut_a and not cut_b and len(shorter) <= 4 and a[0] == b[0]


def contradict(a: str, b: str) -> bool:
    """Whether two canonical names can't name the same: some word of the one with fewer words finds no word of its own
    in the other, or more than initials is left over there (but a surname may stand alone)."""
    few, many = sorted((_words(a), _words(b)), key=len)
    if len(few) == 1 and (few[0][1] or not (few[0][0] == many[-1][0] or one_edit(few[0][0], many[-1][0]) or _alike(few[0][0], many[-1][0]) >= ALIKE)):
        return True
    free = list(range(len(many)))
    for word, cut in sorted(few, key=lambda x: (x[1], len(x[0]) == 1)):
        fits = [k for k in free if _word_fits(word, cut, *many[k])]
        if not fits:
            return True
        # a whole word first, then initials
        free.remove(min(fits, key=lambda k: (many[k][0] != word, many[k][1] and len(many[k][0]) == 1, k)))
    return len(few) > 1 and any(len(many[k][0]) > 1 for k in free)


def _grams(words: str, read: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the 2- to 5-grams of the words as typed and as read (and of what they are short for) and of their
    initials; and the length of each, 0 for an initial."""
    found = set()
    for w, cut in {*_words(words), *_words(read)}:
        for form in {w, *(() if cut else SHORT.get(w, "").split())}:
            found.add((0, form[0]))
            p = f"^{form}" if cut else f"^{form}$"
            found.update((k, p[i : i + k]) for k in (2, 3, 4, 5) for i in range(len(p) - k + 1))
    sizes, grams = zip(*sorted(found))
    codes = np.array([list(g.ljust(5, "\0").encode("utf-32-le")) for g in grams], np.uint8).reshape(-1, 20).view("<u4").astype(np.uint64)
    sizes = np.array(sizes)
    key = sizes.astype(np.uint64)
    for k in range(5):
        key = mix(key * np.uint64(31) + codes[:, k])
    slots, first = np.unique((key % np.uint64(SLOTS)).astype(np.int64), return_index=True)
    return slots, sizes[first]


def vectors(words: str, read: str, weight: np.ndarray) -> tuple[dict[int, float], dict[int, float]]:
    """Two vectors of unit length by slot: steeply weighted 3- to 5-grams, and plainly weighted 2- to 4-grams."""
    slots, size = _grams(words, read)
    out = []
    for inside, power in (((size == 0) | (size > 2), 3), (size < 5, 1)):
        w = weight[slots[inside]] ** power
        some = w > 0
        norm = float(np.sqrt((w * w).sum())) or 1.0
        out.append(dict(zip(slots[inside][some].tolist(), (w[some] / norm).tolist())))
    return out[0], out[1]


def cosine(a: dict[int, float], b: dict[int, float]) -> float:
    if len(a) > len(b):
        a, b = b, a
    return sum(x * b[k] for k, x in a.items() if k in b)


def distinct_names(*columns: DataFrame) -> DataFrame:
    """Distinct one-column strings of all tables with their number of rows, fillers and strings without two letters
    left out."""
    every = None
    for c in columns:
        c = c.toDF("name")
        every = c if every is None else every.unionByName(c)
    plain = F.lower(F.trim(F.col("name")))
    every = every.where(F.col("name").isNotNull() & ~plain.isin(*FILLERS) & F.col("name").rlike(r"\p{L}.*\p{L}"))
    return every.groupBy("name").agg(F.count("*").alias("rows"))


def word_hubs(spelt: DataFrame) -> DataFrame:
    """``(word, hub)`` of words read as typing errors of a commoner word one edit away. spelt: words, distinct."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [w for x in pdf["words"] for w in {w for w, cut in _words(x) if not cut and len(w) > 3}]
            if out:
                yield pd.DataFrame({"word": out})

    table = materialize(spelt.select("words").mapInPandas(each, "word string").groupBy("word").agg(F.count("*").alias("n")), free=False)
    # two words one edit apart have a word in common that is either of them or lacks one letter of it
    near = F.array_distinct(F.concat(F.array("word"), F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.col("word").substr(i + 1, F.lit(1000))))))
    keys = table.select("word", "n", F.explode(near).alias("key"))
    a, b = keys.alias("a"), keys.alias("b")
    pairs = a.join(b, "key").where(F.expr("a.word <> b.word AND (b.n > a.n OR b.n = a.n AND b.word < a.word) AND (a.n <= 2 OR b.n >= 4 * a.n)"))
    pairs = pairs.select(F.col("a.word").alias("word"), F.col("b.word").alias("hub"), F.col("b.n").alias("n")).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[one_edit(x, y) for x, y in zip(pdf["word"], pdf["hub"])]]

    best = pairs.mapInPandas(verify, "word string, hub string, n long").groupBy("word").agg(F.max(F.struct("n", "hub")).alias("x"))
    hubs = materialize(best.select("word", F.col("x.hub").alias("hub")), free=False)
    # the error of an error goes to the word itself
    onward = hubs.select(F.col("word").alias("hub"), F.col("hub").alias("onward"))
    return materialize(hubs.join(onward, "hub", "left").select("word", F.coalesce("onward", "hub").alias("hub")), free=False)


def read_words(spelt: DataFrame, hubs: DataFrame) -> DataFrame:
    """``words, read``: canonical names as typed and as read."""
    parts = spelt.select("words", F.posexplode(F.split("words", " ")).alias("k", "word")).join(hubs, "word", "left")
    rows = parts.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("hub", "word").alias("r")))).alias("x"))
    return rows.select("words", F.array_join("x.r", " ").alias("read"))


def average_linkage(edges: DataFrame, least: float = LINK) -> DataFrame:
    """``id, grp`` of all ids in ``edges`` (a < b, sim): groups of average linkage that stop at ``least``, named by their
    smallest id; pairs without an edge have a similarity of 0.

    In each round all pairs of groups that are each other's nearest are joined; of equally near ones the pair of the
    smallest ids counts, so there is always such a pair. Sums and sizes are added up by partial aggregation.
    """
    ids = edges.selectExpr("explode(array(a, b)) AS id").distinct()
    members = materialize(ids.select("id", F.col("id").alias("grp")), free=False)
    links = materialize(edges.select("a", "b", F.col("sim").cast("double").alias("s"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")), free=False)
    while True:
        near = links.selectExpr("a", "b", "named_struct('near', s / (na * nb), 'x', -a, 'y', -b) AS o")
        ends = near.selectExpr("a AS u", "o").unionByName(near.selectExpr("b AS u", "o"))
        best = ends.groupBy("u").agg(F.max("o").alias("o")).where(F.col("o.near") >= least)
        # a pair that is the best of both its ends stands there twice
        joined = best.groupBy((-F.col("o.x")).alias("a"), (-F.col("o.y")).alias("b")).agg(F.count("*").alias("n")).where("n = 2")
        joined = materialize(joined.select("b", F.col("a").alias("to")), free=False)
        if joined.isEmpty():
            return members.select("id", "grp")
        to = joined.select(F.col("b").alias("grp"), "to")
        before, members = members, materialize(members.join(to, "grp", "left").select("id", F.coalesce("to", "grp").alias("grp")), free=False)
        sizes = materialize(members.groupBy("grp").agg(F.count("*").alias("n")), free=False)
        moved = links.join(joined.withColumnRenamed("b", "a").withColumnRenamed("to", "ta"), "a", "left").join(joined.withColumnRenamed("to", "tb"), "b", "left")
        moved = moved.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), "s").where("a <> b")
        moved = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"))
        sized = moved.join(sizes.select(F.col("grp").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("grp").alias("b"), F.col("n").alias("nb")), "b")
        old, links = links, materialize(sized.select("a", "b", "s", "na", "nb"))
        discard(before, sizes, joined, old)


def close_pairs(rows: DataFrame, least: float = JOIN) -> DataFrame:
    """Pairs ``a < b``, as a stored table, among which are all of a cosine of at least ``least``. rows: ``key, id, x, rest``,
    the weights of each unit vector's first n-grams by one order of all, and the length of what is left of the vector
    from each on.

    The cosine of two vectors is at most the product of their ``rest`` at the first n-gram that they share. So they are
    joined on those only whose product reaches ``least``, which common n-grams, the last in order, seldom do; and a
    pair goes on if its products so far and the lengths left behind them can reach it. No pair of ``least`` is lost.
    """
    least -= 1e-6
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("rest").alias("most")).where("n > 1")
    # the ids of a key are dealt into parts, and parts are joined with parts, so that no task holds a large group
    parts = F.ceil(F.col("n") / F.lit(DENSE)).cast("int")
    dealt = rows.join(counts, "key").where(F.col("rest") * F.col("most") >= least).select("key", "id", "x", "rest", parts.alias("parts"))
    dealt = materialize(dealt.select("key", "id", "x", "rest", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("own"), F.sequence(F.lit(0), F.col("parts") - 1).alias("other")))
    left = dealt.select("key", F.col("id").alias("a"), F.col("x").alias("xa"), F.col("rest").alias("ra"), F.col("own").alias("pa"), F.explode("other").alias("pb"))
    right = dealt.select("key", F.col("id").alias("b"), F.col("x").alias("xb"), F.col("rest").alias("rb"), F.explode("other").alias("pa"), F.col("own").alias("pb"))
    met = left.join(right, ["key", "pa", "pb"]).where((F.col("a") < F.col("b")) & (F.col("ra") * F.col("rb") >= least))
    behind = lambda r, x: F.sqrt(F.greatest(F.col(r) * F.col(r) - F.col(x) * F.col(x), F.lit(0.0)))
    met = met.select("a", "b", (F.col("xa") * F.col("xb")).alias("dot"), (behind("ra", "xa") * behind("rb", "xb")).alias("behind"))
    summed = met.groupBy("a", "b").agg(F.sum("dot").alias("dot"), F.min("behind").alias("behind"))
    found = materialize(summed.where(F.col("dot") + F.col("behind") >= least).select("a", "b"))
    discard(dealt)
    return found


def entities(*columns: DataFrame) -> DataFrame:
    """``(name, entity)`` of all distinct names; the entity is the hash of the first of its names by code point.

    Each argument is a one-column table of names. Nulls, fillers and strings without two letters are left out, a
    repeated name counts once, and a name without a variant is its own entity. A name of words that don't count is
    an entity of its own spelling.
    """
    names = distinct_names(*columns)
    spark = names.sparkSession

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "words": [canonical(x) for x in pdf["name"]]})

    read = materialize(names.select("name").mapInPandas(fold, "name string, words string"), free=False)
    # spellings of the same words are treated once (few bytes but much work a row: spread over all cores)
    typed = materialize(read.where("words <> ''").select("words").distinct(), free=False)
    spelt = materialize(read_words(typed, word_hubs(typed)).withColumn("id", F.xxhash64("words")).repartition(2 * spark.sparkContext.defaultParallelism, "id"), free=False)

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for pdf in batches:
            for w, x in zip(pdf["words"], pdf["read"]):
                total[_grams(w, x)[0]] += 1
        have = np.flatnonzero(total)
        yield pd.DataFrame({"slot": have, "n": total[have]})

    # at most SLOTS sums reach the driver
    counted = spelt.select("words", "read").mapInPandas(slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(SLOTS)
    df[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    # an n-gram of a single spelling can't match anything and has no weight; one of fewer than RARE spellings is likelier
    # made by a typing error than the mark of a name
    weight = np.where(df > 1, np.log(2 + max(spelt.count(), RARE) / np.maximum(df, RARE)), 0.0).astype(np.float32)
    shared = spark.sparkContext.broadcast(weight)

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, w, as_read in zip(pdf["id"], pdf["words"], pdf["read"]):
                left = 1 + 1e-6  # the weights are rounded, and no length may come out too small
                for slot, x in sorted(vectors(w, as_read, shared.value)[0].items(), key=lambda x: (-x[1], x[0])):
                    if left < JOIN * JOIN:
                        break
                    out.append((slot, i, x, left**0.5))
                    left -= x * x
            if out:
                yield pd.DataFrame(out, columns=["key", "id", "x", "rest"])

    indexed = materialize(spelt.mapInPandas(prefix, "key long, id long, x double, rest double"), free=False)
    pairs = close_pairs(indexed)
    discard(indexed)
    side = lambda x: spelt.select(F.col("id").alias(x), F.col("words").alias(f"w{x}"), F.col("read").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").repartition(2 * spark.sparkContext.defaultParallelism)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vec = lru_cache(maxsize=100_000)(lambda w, r: vectors(w, r, shared.value))
        for pdf in batches:
            out = []
            for a, b, wa, ra, wb, rb in zip(*(pdf[c] for c in ("a", "b", "wa", "ra", "wb", "rb"))):
                if not contradict(ra, rb):
                    x, y = vec(wa, ra), vec(wb, rb)
                    if cosine(x[0], y[0]) >= JOIN:
                        out.append((a, b, cosine(x[1], y[1])))
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "sim"])

    edges = materialize(both.mapInPandas(judge, "a long, b long, sim double"))
    discard(pairs)
    grouped = average_linkage(edges)
    of = spelt.join(grouped, "id", "left").select("words", F.coalesce("grp", "id").cast("string").alias("g"))
    named = read.join(of, "words", "left").select("name", F.coalesce("g", F.concat(F.lit("w:"), "name")).alias("g"))
    named = materialize(named, free=False)
    first = named.groupBy("g").agg(F.xxhash64(F.min("name")).alias("entity"))
    discard(read, typed, spelt, edges)
    return named.join(first, "g").select("name", "entity")


def name_pairs(*columns: DataFrame) -> DataFrame:
    """Pairs ``name_a < name_b`` (by code point) of distinct strings of one entity."""
    e = materialize(entities(*columns), free=False)
    a, b = e.select("entity", F.col("name").alias("name_a")), e.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
