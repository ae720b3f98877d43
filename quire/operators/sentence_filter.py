"""Sentences that are fit to learn from, and why the others aren't: the first rule that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T

#: Signs a sentence may not begin with, and signs of which it may hold three.
LEADING = (".", "'", ";", "~", ":", "-", "·", "‘", "’", "\\")
SPECIAL = r"[~\\/;:_·<>�!]"
REASONS = ("too_few_words", "too_many_short_words", "first_word_is_number", "brackets", "too_many_numbers", "too_many_commas", "begins_with_punctuation", "weird_chars", "first_not_upper", "last_not_dot", "too_many_dots", "valid")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def fix_up(text: Column) -> Column:
    """Without a leading quote, up to five leading digits and spaces (of longer texts), and quotation marks."""
    t = F.regexp_replace(text, "^'", "")
    t = F.when((F.length(t) > 6) & t.rlike("^[0-9]"), F.regexp_replace(t, "^[0-9 ]{1,5}", "")).otherwise(t)
    return F.translate(t, "‘’\"", "")


def reason(sentence: Column, ws: Column | None = None, bare: Column | None = None) -> Column:
    """The first rule a sentence fails, or valid. ``ws`` and ``bare`` are its words and its fixed-up text if they are
    at hand as columns, so that they are worked out once."""
    ws = T.words(sentence) if ws is None else ws
    bare = fix_up(sentence) if bare is None else bare
    n = F.size(ws)
    short = F.size(F.filter(ws, lambda w: F.length(w) < 2))
    numbers = F.size(F.filter(ws, lambda w: w.rlike(r"^[(\[]?[0-9][0-9.,]*[)\].,;:!?]*$")))
    first = F.substring(bare, 1, 1)
    return (
        F.when(n < 5, "too_few_words")
        .when(short * 2 > n, "too_many_short_words")
        .when(first.rlike("[0-9]"), "first_word_is_number")
        .when((_count(sentence, r"\(") >= 3) | (_count(sentence, r"\)") >= 3), "brackets")
        .when(numbers > 3, "too_many_numbers")
        .when(_count(sentence, ",") > 6, "too_many_commas")
        .when(first.isin(*LEADING), "begins_with_punctuation")
        .when(_count(sentence, SPECIAL) > 3, "weird_chars")
        .when(~first.rlike(r"\p{Lu}"), "first_not_upper")
        .when(~F.substring(sentence, -1, 1).isin(".", "?", "!"), "last_not_dot")
        .when(_count(sentence, r"\.") > 3, "too_many_dots")
        .otherwise("valid")
    )


def judged(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, pos, sentence, reason`` of every sentence; null and empty texts have none."""
    each = texts.select(key, F.posexplode(T.sentences(F.col(text))).alias("pos", "sentence"))
    parts = each.select("*", T.words(F.col("sentence")).alias("_ws"), fix_up(F.col("sentence")).alias("_bare"))
    return parts.select(key, "pos", "sentence", reason(F.col("sentence"), F.col("_ws"), F.col("_bare")).alias("reason"))


def histogram(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per text the number of sentences by reason, one column each."""
    return judged(texts, key, text).groupBy(key).pivot("reason", list(REASONS)).agg(F.count(F.lit(1))).na.fill(0)
