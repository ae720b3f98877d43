"""One best record for each group of books that are the same work.

Dependent fields form bundles that are taken whole: the title with its language, the author, and the edition
(format, word and block counts, quality, language). Values are graded (full, cut short, abbreviated, damaged,
missing); trust adds grade, how many members agree, quality, role and recency. A bundle choice must keep the
dependency work -> language: the title's and the edition's language may not differ. Among choices of one bundle and
language only the most trusted can win, so each group comes down to a few candidates per bundle before
branch-and-bound takes the best consistent combination.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.llm import mojibake, names, neardup
from quire.llm.langid import norm_label
from quire.operators.components import connected_components
from quire.runtime import materialize

#: What stands in a title field without being a title.
NO_TITLE = re.compile(
    r"(un(titled|known( title)?|benannt)|no title|title|none|null|n/?a|-+|\?+|test|sans titre|ohne titel|sin t[ií]tulo|senza titolo|sem t[ií]tulo|без названия"
    r"|(new )?(document|dokument|text|book|ebook|file|scan|img|image|output|doc)[ _-]*\d*(\.\w{2,5})?|microsoft word - .*|\d{3,}_.*|[\w \-]+\.(pdf|docx?|epub|html?|txt|djvu|mobi|fb2|rtf|azw3?|odt)|[\d_\W]*)",
    re.I,
)
GRADES = ("missing", "damaged", "cut", "abbreviated", "full")


def grade_title(title: str | None) -> str:
    if title is None or NO_TITLE.fullmatch(title.strip()):
        return "missing"
    if "�" in title or any("\x80" <= c < "\xa0" for c in title):
        return "damaged"
    if title != title.rstrip() or title.endswith(("…", "...")):
        return "cut"
    return "full"


def grade_author(author: str | None) -> str:
    if author is None or author.strip().lower() in names.FILLERS or not re.search(r"[^\W\d_].*[^\W\d_]", author):
        return "missing"
    if "�" in author or any("\x80" <= c < "\xa0" for c in author):
        return "damaged"
    if author.endswith(("…", "...")):
        return "cut"
    words, surname = names.parse(author)
    whole = [w for w, cut in words if not cut]
    if len(whole) < 2 or any(cut and len(w) > 1 for w, cut in words) or words[0][1] and surname > 0:
        return "abbreviated"
    if "," in author and all(cut for k, (_, cut) in enumerate(words) if k != surname):
        return "abbreviated"
    return "full"


def groups(blocks: DataFrame) -> DataFrame:
    """``book_id, group_id`` of books connected by similarity; the group is its smallest book."""
    classes, links = neardup.book_links(neardup.scan_blocks(blocks), blocks)
    edges = links.select("a", "b").unionByName(classes.where("rep <> book_id").selectExpr("rep AS a", "book_id AS b"))
    return connected_components(edges).select(F.col("id").alias("book_id"), F.col("component").alias("group_id"))


_FIELDS = "group_id long, book_id long, title string, title_grade string, author string, author_grade string, lang string, source_format string, word_count long, block_count long, quality double, updated_at timestamp, role int"


def broken_titles(rows: DataFrame, books: DataFrame) -> DataFrame:
    """``title, broken`` of titles whose last word stands in no other title but begins a word of several others: they
    end inside a word."""
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))
    every = books.where("title IS NOT NULL").select("title").distinct().select("title", F.explode(F.array_distinct(split(F.col("title")))).alias("word"))
    count = every.groupBy("word").agg(F.count("*").alias("n"))
    longer = count.where("n > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", F.lit(1), i))).alias("last"), "word")
    longer = longer.where("last <> word").select("last").distinct()
    ends = rows.where("title_grade = 'full'").select("title").distinct().where(F.col("title").rlike(r"\p{L}$")).withColumn("last", F.element_at(split(F.col("title")), -1)).where(F.length("last") > 2)
    alone = ends.join(count.where("n = 1").select(F.col("word").alias("last")), "last")
    return alone.join(longer, "last").select("title", F.lit(True).alias("broken"))


def graded_members(books: DataFrame, book_files: DataFrame, group: DataFrame, model: mojibake.PairModel) -> DataFrame:
    """Members of the groups with a grade for title and author. A title that begins a longer one of its group is cut."""
    shared = books.sparkSession.sparkContext.broadcast(model)
    order = F.create_map(*[F.lit(x) for k, v in {"primary": 3, "member": 2, "alternate_format": 1, "duplicate": 0}.items() for x in (k, v)])
    role = book_files.groupBy("book_id").agg(F.max(F.coalesce(F.try_element_at(order, "role"), F.lit(0))).alias("role"))
    slim = books.select(F.col("id").alias("book_id"), "title", "author", norm_label(F.col("language")).alias("lang"), "source_format", "word_count", "block_count", "quality", "updated_at").dropDuplicates(["book_id"])
    of = slim.join(group, "book_id").join(role, "book_id", "left").na.fill({"role": 0})

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = mojibake.Finder(shared.value)
        for pdf in batches:
            if not len(pdf):
                continue
            for field, judge in (("title", grade_title), ("author", grade_author)):
                values = [x if isinstance(x, str) else None for x in pdf[field]]
                made = [judge(x) for x in values]
                pdf[f"{field}_grade"] = ["damaged" if g != "missing" and hit else g for g, hit in zip(made, find(values))]
            yield pdf[[x.split()[0] for x in _FIELDS.split(", ")]]

    rows = of.mapInPandas(grade, _FIELDS)
    rows = materialize(rows)
    whole = lambda f: F.max(F.when(F.col(f"{f}_grade") == "full", F.struct(F.length(f).alias("n"), F.col(f).alias("v"))))
    longest = rows.groupBy("group_id").agg(whole("title").alias("t"))
    rows = rows.join(broken_titles(rows, books), "title", "left")
    broken = F.col("broken") & (F.col("title_grade") == "full")
    rows = rows.withColumn("title_grade", F.when(broken, "cut").otherwise(F.col("title_grade"))).drop("broken")
    prefix = (F.col("title_grade") == "full") & (F.length("title") < F.col("t.n")) & F.col("t.v").startswith(F.col("title"))
    rows = rows.join(longest, "group_id").withColumn("title_grade", F.when(prefix, "cut").otherwise(F.col("title_grade"))).drop("t")
    return materialize(rows)


def best_combination(options: dict[str, list[tuple[float, str | None, int]]]) -> dict[str, tuple[float, str | None, int]]:
    """Branch and bound over bundles; an option is (trust, language, source). Languages of a choice may not differ."""
    order = sorted(options, key=lambda b: len(options[b]))
    sorted_options = {b: sorted(options[b], key=lambda x: (-x[0], x[2])) for b in order}
    bound = [0.0] * (len(order) + 1)
    for k in range(len(order) - 1, -1, -1):
        bound[k] = bound[k + 1] + (sorted_options[order[k]][0][0] if sorted_options[order[k]] else 0.0)
    best: tuple[float, dict] = (-1.0, {})

    def branch(k: int, total: float, lang: str | None, chosen: dict) -> None:
        nonlocal best
        if total + bound[k] <= best[0]:
            return
        if k == len(order):
            best = (total, dict(chosen))
            return
        for trust, other, source in sorted_options[order[k]]:
            if lang is None or other is None or lang == other:
                chosen[order[k]] = (trust, other, source)
                branch(k + 1, total + trust, lang or other, chosen)
                del chosen[order[k]]
        branch(k + 1, total, lang, chosen)

    branch(0, 0.0, None, {})
    return best[1]


def choose(members: DataFrame) -> DataFrame:
    """One row per group: the chosen members by bundle. members: as made by ``graded_members``."""
    points = F.create_map(*[F.lit(x) for k, g in enumerate(GRADES) for x in (g, k * 100.0)])
    last = F.max("updated_at").alias("last")
    rows = members.join(members.groupBy("group_id").agg(last), "group_id")
    recent = F.coalesce((F.col("updated_at") == F.col("last")).cast("double"), F.lit(0.0)) * 0.5
    base = F.coalesce(F.nanvl("quality", F.lit(0.0)), F.lit(0.0)) + F.col("role") * 0.3 + recent
    parts = []
    for bundle, value, lang in (("title", "title", "lang"), ("author", "author", None), ("edition", None, "lang")):
        langs = F.col(lang) if lang else F.lit(None).cast("string")
        if value:
            # how many members hold the same value; one row per value and language is enough
            each = rows.groupBy("group_id", value, f"{value}_grade", langs.alias("l")).agg(F.count("*").alias("n"), F.max(base).alias("b"), F.min("book_id").alias("book_id"))
            trust = F.element_at(points, F.col(f"{value}_grade")) + F.log1p("n") * 10 + F.col("b")
        else:
            each = rows.groupBy("group_id", langs.alias("l")).agg(F.max(F.struct((base + F.log1p(F.coalesce("word_count", F.lit(0)))).alias("b"), (-F.col("book_id")).alias("m"))).alias("x"))
            each = each.select("group_id", "l", F.col("x.b").alias("b"), (-F.col("x.m")).alias("book_id"))
            trust = F.col("b")
        option = F.struct(F.round(trust, 9).alias("trust"), (-F.col("book_id")).alias("m"))
        top = each.groupBy("group_id", "l").agg(F.max(option).alias("o"))
        parts.append(top.select("group_id", F.lit(bundle).alias("bundle"), F.col("o.trust").alias("trust"), F.col("l").alias("lang"), (-F.col("o.m")).alias("book_id")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    few = every.groupBy("group_id").agg(F.collect_list(F.struct("bundle", "trust", "lang", "book_id")).alias("options"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, options in zip(pdf["group_id"], pdf["options"]):
                table: dict[str, list] = {"title": [], "author": [], "edition": []}
                for o in options:
                    table[o["bundle"]].append((o["trust"], o["lang"], o["book_id"]))
                made = best_combination(table)
                out.append((g, *[made[b][2] if b in made else None for b in ("title", "author", "edition")], sum(x[0] for x in made.values())))
            if out:
                yield pd.DataFrame(out, columns=["group_id", "title_from", "author_from", "edition_from", "trust"]).astype({c: "Int64" for c in ("title_from", "author_from", "edition_from")})

    return few.mapInPandas(run, "group_id long, title_from long, author_from long, edition_from long, trust double")


def survivors(blocks: DataFrame, books: DataFrame, book_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graded members, and one surviving record per group with the book each bundle was taken from.

    Books in no group of two or more have no row. Null fields are graded missing; ties go to the smallest book.
    """
    group = materialize(groups(blocks))
    model = mojibake.pair_model(mojibake.records(blocks, books).where("text IS NOT NULL"))
    members = graded_members(books, book_files, group, model)
    picked = choose(members)
    for bundle, fields in (("title", ["title", "title_grade", "lang"]), ("author", ["author", "author_grade"]), ("edition", ["source_format", "word_count", "block_count", "quality"])):
        side = members.select(F.col("group_id"), F.col("book_id").alias(f"{bundle}_from"), *fields)
        picked = picked.join(side, ["group_id", f"{bundle}_from"], "left")
    return members, materialize(picked)


def found(blocks: DataFrame, books: DataFrame, book_files: DataFrame) -> DataFrame:
    """``group_id, field, book_id``: fields whose chosen value is full while some member's is not, with the smallest
    book that holds the chosen value."""
    members, picked = survivors(blocks, books, book_files)
    out = None
    for field in ("title", "author"):
        chosen = picked.where(F.col(f"{field}_grade") == "full").select("group_id", F.col(field).alias("v"))
        full = F.col(f"{field}_grade") == "full"
        rows = members.join(chosen, "group_id").groupBy("group_id").agg(F.min(F.when(F.col(field) == F.col("v"), F.col("book_id"))).alias("book_id"), F.max((~full).cast("int")).alias("lesser"))
        rows = rows.where("lesser = 1").select("group_id", F.lit(field).alias("field"), "book_id")
        out = rows if out is None else out.unionByName(rows)
    return out
