"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import incremental, langid, mixing, mojibake, names, neardup, packing, pagenoise, repetition, survivors
from quire.runtime import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return pagenoise.noise(table(spark, root, "blocks"), table(spark, root, "books"))


def p1_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return pagenoise.paragraphs(table(spark, root, "blocks"), table(spark, root, "books"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return names.name_pairs(table(spark, root, "books").select("author"), table(spark, root, "files").select("author"))


def p2_entities(spark: SparkSession, root: str) -> DataFrame:
    return names.entities(table(spark, root, "books").select("author"), table(spark, root, "files").select("author"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    made = mojibake.damaged_records(table(spark, root, "blocks"), table(spark, root, "books"))
    return made.select("rec_table", "book_id", "seq").distinct()


def p3_restored(spark: SparkSession, root: str) -> DataFrame:
    return mojibake.damaged_records(table(spark, root, "blocks"), table(spark, root, "books"))


def _p4_tables(spark: SparkSession, root: str) -> list[DataFrame]:
    return [table(spark, root, t) for t in ("blocks", "books", "files", "book_files")]


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return langid.corrections(*_p4_tables(spark, root))


def p4_languages(spark: SparkSession, root: str) -> DataFrame:
    return langid.assigned(*_p4_tables(spark, root))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return neardup.found_pairs(table(spark, root, "blocks"))


def p5_block_classes(spark: SparkSession, root: str) -> DataFrame:
    return neardup.block_classes(table(spark, root, "blocks"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_items(spark, root).where("match_kind <> 'new'")


def p6_items(spark: SparkSession, root: str) -> DataFrame:
    return incremental.classify(*[table(spark, root, t) for t in ("incoming", "books", "book_files")])


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return survivors.found(*[table(spark, root, t) for t in ("blocks", "books", "book_files")])


def p7_survivors(spark: SparkSession, root: str) -> DataFrame:
    return survivors.survivors(*[table(spark, root, t) for t in ("blocks", "books", "book_files")])[1]


def p8_packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"), table(spark, root, "container_sizes"))


def p8_unused(spark: SparkSession, root: str) -> DataFrame:
    return packing.unused_space(p8_packed(spark, root), table(spark, root, "container_sizes"))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "source_targets"))[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "source_targets"))[1]


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return repetition.repetitive(table(spark, root, "documents"))


def p10_shares(spark: SparkSession, root: str) -> DataFrame:
    made = repetition.repetition(table(spark, root, "documents"))
    return made.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in made.columns if c.startswith("share_")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


_WORDS = r"list_filter(regexp_extract_all(lower({0}), '\pL+'), lambda x: x <> '')"

_P6 = """
    WITH i AS (SELECT *, row_number() OVER (ORDER BY batch_no, item_id) AS r FROM incoming),
    h AS (SELECT 0 AS r, minhash FROM books WHERE minhash IS NOT NULL UNION ALL SELECT r, minhash FROM i WHERE minhash IS NOT NULL),
    n AS (SELECT DISTINCT i.item_id FROM i JOIN h ON h.r < i.r WHERE i.minhash IS NOT NULL AND
          len(list_filter(list_zip(i.minhash, h.minhash), lambda x: x[1] = x[2])) >= 77),
    k AS (SELECT item_id, CASE WHEN sha256 IN (SELECT sha256 FROM book_files WHERE sha256 IS NOT NULL)
          OR EXISTS (SELECT 1 FROM i e WHERE e.sha256 = i.sha256 AND e.r < i.r) THEN 'exact'
          WHEN item_id IN (SELECT item_id FROM n) THEN 'near' ELSE 'new' END AS match_kind FROM i)"""

SQL: dict[str, str] = {
    "p5_found": f"""
        WITH b AS (SELECT DISTINCT book_id, seq, text FROM blocks),
        t AS (SELECT 'blocks' AS rec_table, book_id, seq, {_WORDS.format('text')} AS w FROM b
              UNION ALL SELECT 'books', book_id, -1, {_WORDS.format("string_agg(text, chr(10) ORDER BY seq)")} FROM b GROUP BY book_id),
        g AS (SELECT DISTINCT rec_table, book_id, seq, hash(list_slice(w, i, i + 4)) AS g
              FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) AS i FROM t
                    WHERE len(w) >= CASE rec_table WHEN 'books' THEN 5 ELSE 40 END)),
        n AS (SELECT rec_table, book_id, seq, count(*) AS n FROM g GROUP BY ALL),
        p AS (SELECT a.rec_table, a.book_id AS book_a, a.seq AS seq_a, b.book_id AS book_b, b.seq AS seq_b, count(*) AS c
              FROM g a JOIN g b ON a.rec_table = b.rec_table AND a.g = b.g AND a.book_id < b.book_id GROUP BY ALL),
        s AS (SELECT p.* FROM p JOIN n x ON x.rec_table = p.rec_table AND x.book_id = book_a AND x.seq = seq_a
              JOIN n y ON y.rec_table = p.rec_table AND y.book_id = book_b AND y.seq = seq_b
              WHERE c * 1000 >= 600 * (x.n + y.n - c))
        SELECT rec_table, book_a, seq_a, book_b, seq_b FROM s
        WHERE rec_table = 'books' OR NOT EXISTS (SELECT 1 FROM s o WHERE o.rec_table = 'books'
              AND o.book_a = s.book_a AND o.book_b = s.book_b)""",
    "p6_items": _P6 + " SELECT item_id, match_kind FROM k",
    "p6_found": _P6 + " SELECT item_id, match_kind FROM k WHERE match_kind <> 'new'",
    "p10_found": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
        g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
              FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 20)),
        h AS (SELECT r, i, row_number() OVER (PARTITION BY r, g ORDER BY i) AS n FROM g),
        c AS (SELECT DISTINCT r, i + j AS at FROM h, (SELECT unnest(generate_series(0, 4)) AS j) WHERE n > 1),
        s AS (SELECT r, count(*) AS k FROM c GROUP BY r)
        SELECT DISTINCT doc_id FROM s JOIN d USING (r) WHERE k >= 0.3 * len(w)""",
}
