from pyspark.sql import functions as F

from quire.functions import text as T


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*[c(F.col("t")).alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_cleaning(spark):
    assert one(spark, "a beauti-\nful day\nindeed", T.clean_page_text)[0] == "a beautiful day indeed"
    assert one(spark, "one\ntwo\n\nthree\n\n\n four ", T.split_paragraphs)[0] == ["one two", "three", "four"]
    assert one(spark, " a b \t c", T.normalize_ws)[0] == "a b c"


def test_nulls_and_empty(spark):
    row = one(spark, None, T.normalize_ws, T.count_words, T.quality_score, T.sentences, T.excerpt)
    assert tuple(row) == (None, 0, 0.0, None, None)
    row = one(spark, "", T.normalize_ws, T.count_words, T.quality_score, T.sentences, T.excerpt)
    assert tuple(row) == ("", 0, 0.0, [], "")


def test_quality(spark):
    assert one(spark, "Books were read by lamplight, and then put back.", T.quality_score)[0] > 0.95
    assert one(spark, "\x02" * 300 + "ok", T.quality_score)[0] < 0.1


def test_sentences_match_a_plain_split(spark):
    import re

    text = "One. Two!  Three?\nFour… five. (1875). “Six.” seven"
    expected = [s.strip() for s in re.split(r"(?<=[.!?…])\s+", text) if s.strip()]
    assert one(spark, text, T.sentences)[0] == expected


def test_paths_and_keys(spark):
    row = one(spark, "a/b/My_Book.v2.epub", T.basename, T.parent, T.stem, T.extension, T.title_from_filename)
    assert tuple(row) == ("My_Book.v2.epub", "a/b", "My_Book.v2", "epub", "My Book v2")
    keys = [one(spark, x, T.natural_key)[0] for x in ("page_2", "page_10", "page_1")]
    assert sorted(keys) == [keys[2], keys[0], keys[1]]


def test_locators(spark):
    df = spark.createDataFrame([(3, 4, 0, "I"), (None, None, 1, None), (None, None, None, "x"), (5, 5, None, None)], "p int, q int, c int, t string")
    rows = df.select(T.block_locator(F.col("p"), F.col("c"), F.col("t")), T.passage_locator(F.col("p"), F.col("q"), F.col("c"), F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("p. 3", "pp. 3–4"), ("chapter 2", "chapter 2"), ("text", "x"), ("p. 5", "p. 5")]


def test_highlight_escapes(spark):
    df = spark.createDataFrame([("a <b> Mill & mills", "mill")], "t string, q string")
    assert df.select(T.highlight(F.col("t"), F.col("q"))).first()[0] == "a &lt;b&gt; <mark>Mill</mark> &amp; mills"


def test_fold_and_tokens(spark):
    assert one(spark, "Café ÉTÉ_2 Ångström", T.index_tokens)[0] == ["cafe", "ete", "2", "angstrom"]


def test_composed_letters(spark):
    import unicodedata

    texts = ["cafe\u0301 n\u0303 \u0438\u0306 u\u0308\u0301 x\u0301\u0327", "plain", "", None, "\u0301start", "A\u030a\ne\u0301"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.compose(F.col("t"))).collect()]
    for t, g in zip(texts, got):
        if t != texts[0]:
            assert g == (None if t is None else unicodedata.normalize("NFC", t))
    assert got[0].startswith("caf\u00e9 \u00f1 \u0439 \u01d8 ")


def test_titles_that_say_something(spark):
    df = spark.createDataFrame([("Microsoft Word - x.doc", "The Mill", "d/f.pdf"), ("scan12", "", "d/some_file.name.pdf"), (None, "Printed Matter", "x"), (" A Book ", "b", "x")], "a string, b string, p string")
    assert [r[0] for r in df.select(T.pick_title(F.col("a"), F.col("b"), path=F.col("p"))).collect()] == ["The Mill", "some file name", "Printed Matter", " A Book "]
