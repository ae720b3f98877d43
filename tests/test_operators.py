import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import catalog, chunking, dedup, dense, evaluation, fusion, lexical, ocr_metrics, ordered, planner, report, sentence_filter
from quire.operators.components import connected_components

T0 = datetime(2024, 1, 1)
FILES = "path string, size long, mtime_ns long, format string, status string, sha256 string, pages int, text_class string, word_estimate long, language string, title string, has_metadata boolean, contains map<string,int>, error string, probe_version int, surveyed_at timestamp"


def manifest(spark):
    rows = [
        ("a/clean.pdf", 10, 1, "pdf", "ok", "h1", 4, "text", 600, "en", "Clean Text Book", True, None, None, 3, T0),
        ("a/old scan.pdf", 20, 1, "pdf", "ok", "h2", 3, "scanned", 0, None, "Old", False, None, None, 3, T0),
        ("a/broken.pdf", 5, 1, "pdf", "corrupt", "h3", None, None, None, None, None, False, None, "bad", 3, T0),
        ("ebook one.epub", 30, 1, "epub", "ok", "h4", None, "text", 900, "en", "Ebook (2nd ed.) One", True, None, None, 3, T0),
        ("a/ebook one (copy).epub", 30, 1, "epub", "ok", "h4", None, "text", 900, "en", "Ebook [x] One", True, None, None, 3, T0),
        ("bundle.zip", 9, 1, "zip", "unsupported", "h5", None, None, None, None, None, False, {"epub": 1, "pdf": 1}, "archive", 3, T0),
        ("x/~$thesis.doc", 1, 1, "doc", "unsupported", "h6", None, None, None, None, None, False, None, None, 3, T0),
        ("a/clean.pdf", 11, 2, "pdf", "ok", "h1b", 4, "text", 700, "", "Clean Text Book", True, None, None, 3, T0 + timedelta(days=1)),
        (None, 1, 1, "txt", "ok", None, None, None, None, None, None, None, None, None, 3, T0),
    ]
    return spark.createDataFrame(rows + rows[:1], FILES)


def test_manifest_report(spark):
    m = report.latest(manifest(spark))
    assert m.count() == 7
    assert {r.format: r.files for r in report.group_counts(m, "format").collect()} == {"pdf": 3, "epub": 2, "zip": 1, "doc": 1}
    t = report.totals(m).first()
    assert (t.files, t.ebook_files, t.usable_ebooks, t.unknown_language) == (7, 5, 4, 2)
    d = report.duplicate_totals(m).first()
    assert tuple(d) == (1, 1, 30)
    assert tuple(report.works_estimate(m).first()) == (2, 1)
    assert tuple(report.archives(m).first()) == (1, 2)
    assert report.size_inputs(m).first().scanned_pages == 3
    assert '"totals"' in report.report(manifest(spark)).first()[0]


def test_report_of_nothing(spark):
    empty = manifest(spark).where("false")
    assert tuple(report.totals(empty).first())[:3] == (0, 0, 0)
    assert report.estimates(report.size_inputs(empty)).first().chunks == 0
    assert report.exact_duplicates(empty).count() == 0


def test_routes(spark):
    m = report.latest(manifest(spark))
    known = spark.createDataFrame([("h4",), (None,)], "sha256 string")
    got = {r.path: r.outcome for r in planner.routes(m, known).collect()}
    assert got == {"a/clean.pdf": "pdf", "a/old scan.pdf": "register", "ebook one.epub": "already_ingested", "x/~$thesis.doc": "lock_artifact"}


@pytest.mark.parametrize("names, expected", [([f"page_{i}" for i in range(1, 12)], True), ([f"treatise_split_{c}" for c in "abcdefgh"], True), (["apple", "bear", "cat", "dog", "elk", "fox", "gnu", "hen"], False), (["page_1", "page_2"], False)])
def test_exploded_books(spark, names, expected):
    rows = [(f"d/03 My Title/files/{n}.html", 1, 1, "html", "ok", f"s{n}", None, "text", 1, None, None, False, None, None, 3, T0) for n in names]
    files = spark.createDataFrame(rows, FILES)
    found = planner.exploded_dirs(planner.representatives(planner.candidates(files))).collect()
    assert bool(found) == expected
    if expected:
        assert found[0].title == "My Title"
        order = [r.path for r in planner.exploded_members(files).orderBy("position").collect()]
        assert order[0].endswith(f"{names[0]}.html") and order[-1].endswith(f"{names[-1]}.html")


def test_connected_components_against_union_find(spark):
    rng = random.Random(3)
    for n, m in ((60, 40), (200, 260)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_chunks(sentences, target=300, most=450, overlap=45):
    """The rule for one chapter, step by step."""
    out, cur, i = [], [], 0
    size = lambda x: sum(len(s.split()) for s in x)

    def tail(x):
        k = len(x)
        while k and size(x[k - 1 :]) <= overlap:
            k -= 1
        return x[k:]

    while i < len(sentences):
        s = sentences[i]
        if cur and size(cur) + size([s]) > most:
            out.append(" ".join(cur))
            cur = tail(cur)
            if size(cur) + size([s]) > most:
                cur = []
            continue
        cur.append(s)
        i += 1
        if size(cur) >= target:
            out.append(" ".join(cur))
            cur = tail(cur) if i < len(sentences) else []
    if cur and (not out or " ".join(cur) not in out[-1]):
        out.append(" ".join(cur))
    return out


BLOCKS = "book_id long, seq int, chapter_idx int, chapter_title string, page int, char_offset int, word_count int, text string"


def test_chunks_against_the_rule(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for book in range(6):
        sentences = []
        for seq in range(30):
            part = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice((3, 9, 20, 60, 700 if book == 3 else 40)))) + "." for _ in range(rng.randrange(4))]
            sentences += part
            rows.append((book, seq, None, None, seq + 1, None, 0, " ".join(part)))
        expected[book] = plain_chunks(sentences)
    rng.shuffle(rows)
    got = chunking.chunk(spark.createDataFrame(rows + rows[:20] + [(1, None, None, None, None, None, 0, "x")], BLOCKS)).orderBy("book_id", "seq").collect()
    for book, texts in expected.items():
        assert [r.text for r in got if r.book_id == book] == texts
        assert [r.seq for r in got if r.book_id == book] == list(range(len(texts)))


def test_chunks_keep_chapters_apart_and_repetition_short(spark):
    fox = " ".join(["The quick brown fox jumps over the lazy dog."] * 40)
    rows = [(1, 0, None, None, None, 0, 0, fox)] + [(2, i, i // 4, f"C{i // 4}", None, 0, 0, f"Chapter words number {i} are here.") for i in range(12)] + [(3, 0, 0, None, None, None, 0, None), (4, 0, 0, None, None, None, 0, "")]
    got = chunking.chunk(spark.createDataFrame(rows, BLOCKS)).collect()
    assert [r.word_count for r in got if r.book_id == 1] == [306]
    assert sorted(r.chapter_idx for r in got if r.book_id == 2) == [0, 1, 2]
    assert not [r for r in got if r.book_id > 2]
    assert chunking.chunk(spark.createDataFrame([], BLOCKS)).count() == 0


def test_bm25_ranks_and_repeated_words(spark):
    docs = spark.createDataFrame([(1, "The café of the mill"), (2, "a mill, a mill, a mill"), (3, "nothing here"), (4, None), (5, "")], "id long, text string")
    q = spark.createDataFrame([(1, "mill"), (2, "CAFE"), (3, "..."), (4, "mill mill cafe")], "query_id int, query string")
    got = lexical.bm25(docs, q, 5).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.id)
    assert by[1] == [2, 1] and by[2] == [1] and 3 not in by and set(by[4]) == {1, 2}


def test_cosine_in_blocks_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 3)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(500, None), (501, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for far in (False, True):
        got = dense.cosine_top(v, q, 5, farthest=far).collect()
        for i in range(7):
            s = np.round(u @ u[i], 6)
            want = sorted(range(200), key=lambda k: (s[k] if far else -s[k], k))[:5]
            assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == want
    assert dense.cosine_top(v, q.where("false"), 5).count() == 0


def test_fusion_prefers_agreement(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id int, id long, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 9, 2), (0, 1, 3)], "query_id int, id long, rank int")
    s = {r.id: r.score for r in fusion.rrf([a, b]).collect()}
    assert s[2] > s[9] and s[1] > s[3]


def books(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, author string, language string, status string, source_format string, needs_ocr boolean, word_count long, block_count long, minhash array<long>, created_at timestamp")


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 32, (12, 128))
    sigs = []
    for i in range(60):
        s = base[i % 12].copy()
        change = rng.choice(128, rng.integers(0, 70), replace=False)
        s[change] = rng.integers(0, 1 << 32, len(change))
        sigs.append([int(x) for x in s])
    sigs += [sigs[0], sigs[0], None, [1, 2]]
    df = books(spark, [(i, None, None, None, "extracted", "epub", False, 1000, 1, s, T0) for i, s in enumerate(sigs)])
    want = {(i, j) for i in range(62) for j in range(i + 1, 62) if sum(x == y for x, y in zip(sigs[i], sigs[j])) >= 77}
    assert {(r.a, r.b) for r in dedup.similar_pairs(df).collect()} == want and want
    new = spark.createDataFrame([(3,)], "id long")
    assert {(r.a, r.b) for r in dedup.similar_pairs(df, new_ids=new).collect()} == {p for p in want if 3 in p}


def test_merges_choose_format_and_length(spark):
    sig = list(range(128))
    df = books(spark, [(1, None, None, None, "extracted", "pdf", False, 900, 1, sig, T0), (2, None, None, None, "extracted", "epub", False, 700, 1, sig, T0), (3, None, None, None, "extracted", "txt", False, 800, 1, sig, T0), (4, None, None, None, "extracted", "txt", False, 9000, 1, sig, T0)])
    pairs = dedup.similar_pairs(df)
    assert {(r.canonical, r.alternate) for r in dedup.merges(df, pairs).collect()} == {(2, 1), (2, 3)}


def test_jaccard_pairs_against_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for i in range(40):
        base = [f"w{chr(97 + rng.randrange(20))}" for _ in range(60)] if i % 4 == 0 else texts[-1].split()
        base = list(base)
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = "changed"
        texts.append(" ".join(base))
    texts += [texts[0], None, "", "short one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    import re

    def grams(t):
        w = re.findall(r"[^\W\d_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: g for i, t in enumerate(texts) if (g := grams(t))}
    classes, pairs = dedup.jaccard_pairs(df, "id", threshold=0.6)
    rep = {r.id: r.rep for r in classes.collect()}
    assert rep == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) * 1000 >= 600 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want


def test_signatures_estimate_similarity(spark):
    a = " ".join(f"x{chr(97 + i % 23)}{chr(97 + i % 17)}" for i in range(300))
    b = " ".join(a.split()[:240] + ["zz"] * 60)
    rows = {r.id: r.minhash for r in dedup.signatures(spark.createDataFrame([(1, a), (2, b), (3, None), (4, a)], "id long, text string"), "id").collect()}
    assert rows[3] is None and rows[1] == rows[4] and len(rows[1]) == 128
    assert 0.5 < np.mean([x == y for x, y in zip(rows[1], rows[2])]) < 0.95


def test_catalog_merge_and_replace(spark):
    b = books(spark, [(1, "A", None, "en", "extracted", "epub", False, 10, 1, None, T0), (2, "B", None, None, "awaiting_ocr", "pdf", True, 0, 0, None, T0)])
    files = spark.createDataFrame([("s1", 1, "p1", "primary"), ("s2", 2, "p2", "primary"), ("s3", 2, "p3", "duplicate")], "sha256 string, book_id long, path string, role string")
    blocks = spark.createDataFrame([(1, 0, 10, "x"), (2, 0, 1, "old")], "book_id long, seq int, word_count int, text string")
    nb, nf, nk = catalog.merge_books(b, files, blocks, spark.createDataFrame([(1, 2)], "canonical long, alternate long"))
    assert [r.id for r in nb.collect()] == [1] and [r.book_id for r in nk.collect()] == [1]
    assert {(r.sha256, r.book_id, r.role) for r in nf.collect()} == {("s1", 1, "primary"), ("s2", 1, "alternate_format"), ("s3", 1, "duplicate")}
    read = spark.createDataFrame([(2, 0, 4, "new a"), (2, 1, 5, "new b")], "book_id long, seq int, word_count int, text string")
    langs = spark.createDataFrame([(2, "de")], "book_id long, language string")
    for _ in range(2):
        b, blocks = catalog.replace_blocks(b, blocks, read, langs)
    row = {r.id: r for r in b.collect()}
    assert (row[2].status, row[2].language, row[2].block_count, row[1].language) == ("extracted", "de", 2, "en")
    assert blocks.count() == 3


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([("a", 1, 1, 3), ("b", 1, 1, 3)], "path string, size long, mtime_ns long, probe_version int")
    new = spark.createDataFrame([("a", 1, 1, 3), ("b", 2, 5, 3), ("c", 1, 1, 3)], old.schema)
    assert {r.path for r in catalog.changed_files(new, old).collect()} == {"b", "c"}
    assert {(r.path, r.size) for r in catalog.upsert(old, new, "path", "mtime_ns").collect()} == {("a", 1), ("b", 2), ("c", 1)}


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, "q", 7, None, "Lazy  dog", None), (2, "q", None, "the fox", None, None), (3, "q", None, "absent", None, None)], evaluation.CASES)
    hits = spark.createDataFrame([(1, 1, 6, "T", "A", "x"), (1, 2, 7, "T", "A", "the LAZY dog"), (2, 1, 9, "About The Fox", None, "y")], "case_id int, rank int, book_id long, title string, author string, text string")
    ranks = evaluation.first_ranks(cases, hits)
    assert {r.case_id: r.rank for r in ranks.collect()} == {1: 2, 2: 1, 3: None}
    m = evaluation.metrics(ranks).first()
    assert (m.cases, m.hits, round(m.hit_rate, 3), m.mrr) == (3, 2, 0.667, 0.5)
    assert tuple(evaluation.metrics(ranks.where("false")).first()) == (0, 0, 0.0, 0.0)


def test_page_metrics(spark):
    pages = spark.createDataFrame([("a", "s", 1, "the “cat” sat"), ("b", "s", 1, "thc 'cat' sat on"), ("a", "s", 2, "")], "engine string, slug string, page int, text string")
    truth = spark.createDataFrame([("s", 1, 'the "cat" sat')], "slug string, page int, truth string")
    words = spark.createDataFrame([("the",), ("cat",)], "word string")
    got = {(r.engine, r.page): r for r in ocr_metrics.score_pages(pages, truth, words).collect()}
    assert got["a", 1].cer == 0 and got["a", 1].wer == 0 and got["a", 2].cer is None
    assert abs(got["b", 1].wer - 1.0) < 1e-6 and abs(got["b", 1].dict_ratio - 0.25) < 1e-6
    assert ocr_metrics.pairwise(pages).first().pages == 1
    assert {(r.engine, r.slug) for r in ocr_metrics.means(ocr_metrics.score_pages(pages, truth, words)).collect()} == {("a", "s"), ("a", None), ("b", "s"), ("b", None)}


def test_word_errors_of_every_page(spark, data):
    from quire.plans.queries import FOUND

    key = lambda q: {(r.engine, r.slug, r.page) for r in FOUND[q](spark, data).select("engine", "slug", "page").collect()}
    made = FOUND["page_word_errors"](spark, data)
    assert key("page_word_errors") == key("page_scores")
    assert made.where("wer IS NULL OR page IS NULL").count() == 0


@pytest.mark.parametrize("text, why", [("Too short.", "too_few_words"), ("A b c d e f.", "too_many_short_words"), ("1234567 was a good year here.", "first_word_is_number"), ("lower case starts are not sentences.", "first_not_upper"), ("This one never ends properly here", "last_not_dot"), ("This is a perfectly fine sentence.", "valid"), ("Many, many, many, many, many, many, many, commas here.", "too_many_commas")])
def test_sentence_reasons(spark, text, why):
    assert spark.createDataFrame([(text,)], "t string").select(sentence_filter.reason(F.col("t"))).first()[0] == why


def test_only_missing_vectors_are_made(spark, tmp_path):
    path, asked = str(tmp_path / "v"), spark.sparkContext.accumulator(0)

    def encode(texts):
        asked.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    chunks = lambda n: spark.createDataFrame([(i, 1, "x" * i) for i in range(n)], "chunk_id long, book_id long, text string")
    for n, seen in ((3, 3), (5, 5), (5, 5)):
        chunking.embed_missing(chunks(n), path, encode)
        assert spark.read.parquet(path).count() == n and asked.value == seen


def test_postings_grow_and_shrink(spark, tmp_path):
    docs = lambda rows: spark.createDataFrame(rows, "id long, text string")
    old = [(i, f"common word{i % 7} word{i % 3}") for i in range(40)] + [(90, None), (91, "")]
    index = lexical.Postings(spark, f"file://{tmp_path}/index")
    assert index.versions() == []
    index.write(0, docs(old))
    for _ in range(2):  # the same version twice
        index.write(1, docs([(3, "changed entirely"), (200, "word1 again")]), gone=docs([(3, ""), (4, ""), (999, "")]))
    now = [r for r in old if r[0] not in (3, 4)] + [(3, "changed entirely"), (200, "word1 again")]
    queries = spark.createDataFrame([(1, "common word1 word1"), (2, "changed"), (3, "nothing here"), (4, ""), (5, "again common word2 word5")], "query_id int, query string")
    want = sorted(map(tuple, lexical.bm25(docs(now), queries, 5).collect()))
    assert sorted(map(tuple, index.search(queries, 5).collect())) == want and len(want) == 11


def test_bounds_on_scores_lose_nothing(spark):
    import math

    rng = random.Random(3)
    # a word in nearly all, some in many and some in few
    texts = [(i, " ".join(["the"] * rng.randrange(0, 4) + [f"m{rng.randrange(6)}" for _ in range(rng.randrange(0, 8))] + [f"r{rng.randrange(60)}" for _ in range(2)])) for i in range(300)]
    asked = [(q, " ".join(["the", f"m{q % 6}", f"m{(q + 1) % 6}", f"r{q}", f"r{q + 20}"][: 1 + q % 5])) for q in range(20)]
    split = {i: t.split() for i, t in texts}
    avg = sum(map(len, split.values())) / len(split)
    df = Counter(t for ws in split.values() for t in set(ws))
    want = set()
    for q, query in asked:
        scored = []
        for i, ws in split.items():
            found = [(max(math.log((len(split) - df[t] + 0.5) / (df[t] + 0.5)), 1e-6), ws.count(t)) for t in query.split() if t in ws]
            if found:
                scored.append((-round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg)) for idf, tf in found), 9), i))
        want |= {(q, i, r) for r, (_, i) in enumerate(sorted(scored)[:5], 1)}
    got = lexical.bm25(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "query_id int, query string"), 5)
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == want


def test_steps_of_passages_lose_nothing():
    rng = np.random.default_rng(5)
    tf = rng.poisson(0.4, (300, 12)) * (rng.random((300, 12)) < np.linspace(0.9, 0.05, 12))
    idf = np.linspace(1e-6, 4, 12)
    asked = np.array([(q, t) for q in range(30) for t in range(12) if (q * 7 + t * 5) % 3 == 0 or t == q % 12])
    asked = asked[np.lexsort((asked[:, 0], asked[:, 1]))]
    share = tf / (tf + 1.0)
    block = lexical._Block(30, asked[:, 0], asked[:, 1], idf[asked[:, 1]], 4)
    keys = rng.permutation(1000)[:300]
    looked_up = False
    for a, b in [(0, 5), (5, 40), (40, 41), (41, 160), (160, 300)]:
        t, d = np.nonzero(tf[a:b].T)
        block.add(keys[a:b], t * (b - a) + d, share[a:b].T[t, d])
        looked_up |= bool((block.rest < block.reached[block.of] - 1e-6).any())
    want = set()
    for q in range(30):
        mine = asked[asked[:, 0] == q, 1]
        scored = sorted((-round(float((share[i, mine] * idf[mine]).sum()), 9), int(keys[i])) for i in range(300) if tf[i, mine].any())
        want |= {(q, k, -s) for s, k in scored[:4]}
    got = {(int(q), int(k), round(float(s), 9)) for q, k, s in zip(block.q, block.key, block.score)}
    assert looked_up and {x[:2] for x in got} == {x[:2] for x in want} and len(got) == len(want)


def test_passages_of_one_key_count_together(spark):
    docs = spark.createDataFrame([(1, "mill"), (1, "mill"), (2, "mill stone"), (3, "stone house"), (4, "harbour"), (5, None)], "id long, text string")
    q = spark.createDataFrame([(1, "mill"), (2, "")], "query_id int, query string")
    assert [(r.query_id, r.id) for r in lexical.bm25(docs, q, 5).orderBy("rank").collect()] == [(1, 1), (1, 2)]
    assert lexical.bm25(docs.where("id > 2"), q, 5).collect() == [] and lexical.bm25(docs, q.where("query = ''"), 5).collect() == []


#: Searches that are asked once, for which an index of every word of all documents takes more disk than the documents.
ONCE = ["bm25_topk", "rrf_fusion", "hybrid_search", "eval_first_ranks", "hydrate", "eval_hit_mrr"]


@pytest.mark.parametrize("name", ONCE)
def test_searches_write_no_index(spark, data, monkeypatch, name):
    from quire.plans.queries import FOUND

    def write(*_, **__):
        raise AssertionError("an index was written")

    monkeypatch.setattr(lexical.Postings, "versions", lambda self: [])
    monkeypatch.setattr(lexical.Postings, "write", write)
    assert FOUND[name](spark, data).columns


def test_recommendations_follow_the_manifest(spark):
    schema = "path string, format string, status string, text_class string, language string, sha256 string, size long, pages int, word_estimate long, contains map<string,int>"
    rows = [("a", "doc", "unsupported", None, None, "1", 5, None, None, None), ("b", "pdf", "ok", "scanned", None, "2", 6 * 1024**3, 10, 0, None), ("c", "pdf", "ok", "text", "en", "2", 6 * 1024**3, 10, 100, None), ("d", "zip", "unsupported", None, None, "3", 5, None, None, {"epub": 2})]
    made = {r.topic: r.amount for r in report.recommendations(spark.createDataFrame(rows, schema)).collect()}
    assert made == {"convert_office": 1, "recognise_scans": 1, "skip_copies": 1, "unpack_archives": 1, "detect_languages": 1}
    assert [r.topic for r in report.recommendations(spark.createDataFrame(rows[2:3], schema)).collect()] == ["proceed"]
    assert [r.topic for r in report.recommendations(spark.createDataFrame([], schema)).collect()] == ["proceed"]


@pytest.mark.parametrize("forward", [False, True])
def test_neighbours_and_sums_across_chunks(spark, forward):
    rng = random.Random(12)
    rows = [(k, s, rng.choice((None, 1, 2)), rng.randrange(5)) for k in (1, 2, None) for s in rng.sample(range(-5, 60), 30)]
    df = spark.createDataFrame(rows, "k long, s int, c int, n int")
    got = ordered.running(ordered.neighbour(df, "k", "s", ["s", "c"], "x", forward, size=4), "k", "s", "n", "total", size=4)
    assert got.count() == len(rows)
    for r in got.collect():
        others = [(s, c) for k, s, c, _ in rows if k == r.k and (s > r.s if forward else s < r.s)]
        want = (min if forward else max)(others, key=lambda x: x[0], default=None) if r.k else None
        assert (None if r.x is None else (r.x.s, r.x.c)) == want
        assert r.total == (sum(n for k, s, _, n in rows if k == r.k and s <= r.s) if r.k else None)
    assert ordered.chapter_runs(spark.createDataFrame([], "book_id long, seq int, chapter_idx int")).count() == 0
