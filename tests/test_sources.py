import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import ocr_metrics
from quire.sources import extract, files, sinks
from quire.streaming import incremental

OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>The Book</dc:title>
<dc:creator>Ann Author</dc:creator><dc:language>de-DE</dc:language></metadata><manifest><item id="a" href="zz%20intro.xhtml" media-type="application/xhtml+xml"/>
<item id="b" href="aa_end.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>"""
CONTAINER = '<container xmlns="urn:x"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'


def epub(encryption=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/content.opf", OPF)
        z.writestr("OEBPS/zz intro.xhtml", "<html><head><title>x</title><style>p{}</style></head><body><h1>Intro <i>one</i></h1><p>First <b>bold</b>ly &amp; well.</p><script>no()</script></body></html>")
        z.writestr("OEBPS/aa_end.xhtml", "<p>The very end.</p><p>ab</p>")
        if encryption:
            z.writestr("META-INF/encryption.xml", f'<e xmlns:c="urn:c"><c:CipherReference URI="{encryption}"/></e>')
    return out.getvalue()


def mobi(encryption=0):
    record = struct.pack(">HHIHHHH", 2, 0, 120_000, 1, 4096, encryption, 0) + b"MOBI" + b"\0" * 64 + struct.pack(">III", 200, 8, 0x0409)
    record = record.ljust(200, b"\0") + b"My Title"
    head = b"\0" * 60 + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", 1) + struct.pack(">I", 90) + b"\0" * 8
    return head + record.ljust(300, b"\0")


def dump(tmp_path):
    d = tmp_path / "dump"
    (d / "sub").mkdir(parents=True)
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("x.epub", "1")
        z.writestr("y.pdf", "1")
    made = {"a.epub": epub(), "sub/locked.epub": epub("OEBPS/aa_end.xhtml"), "sub/fonts.epub": epub("f/x.ttf"), "k.mobi": mobi(), "sub/l.azw3": mobi(2), "plain_notes.txt": "Ein Wort.\n\nZwei ü".encode(), "latin.txt": "caf\xe9".encode("latin-1"),
            "page.html": b"<p>Hello there</p>", "empty.txt": b"", "bundle.zip": archive.getvalue(), "bad.zip": b"PK\x03\x04oops", "s.djvu": b"AT&TFORM" + b"\0" * 130_000, "c.cbz": b"PK\x03\x04", "d.docx": b"PK", "p.pdf": b"%PDF-1.4"}
    for name, raw in made.items():
        (d / name).write_bytes(raw)
    return str(d)


def test_probe(spark, tmp_path):
    found = files.scan(spark, dump(tmp_path))

    def pages(raw):
        return {"pages": 4, "texts": ["word " * 60] * 4, "title": "Pdf"}

    rows = {r.path.rpartition("dump/")[2]: r for r in files.probe(found, pages).collect()}
    got = {k: (r.format, r.status, r.text_class) for k, r in rows.items()}
    assert got == {
        "a.epub": ("epub", "ok", "text"), "sub/locked.epub": ("epub", "drm", None), "sub/fonts.epub": ("epub", "ok", "text"), "k.mobi": ("mobi", "ok", "text"), "sub/l.azw3": ("mobi", "drm", None),
        "plain_notes.txt": ("txt", "ok", "text"), "latin.txt": ("txt", "ok", "text"), "page.html": ("html", "ok", "text"), "empty.txt": ("txt", "corrupt", None), "bundle.zip": ("zip", "unsupported", None),
        "bad.zip": ("zip", "corrupt", None), "s.djvu": ("djvu", "ok", "scanned"), "c.cbz": ("comic", "unsupported", None), "d.docx": ("doc", "unsupported", None), "p.pdf": ("pdf", "ok", "text"),
    }
    assert (rows["a.epub"].title, rows["a.epub"].author, rows["a.epub"].language) == ("The Book", "Ann Author", "de")
    assert (rows["k.mobi"].title, rows["k.mobi"].language, rows["k.mobi"].word_estimate) == ("My Title", "en", 20000)
    assert rows["bundle.zip"].contains == {"epub": 1, "pdf": 1} and rows["s.djvu"].pages == 2
    assert rows["empty.txt"].sha256 is None and rows["plain_notes.txt"].title == "plain notes"


def test_extract(spark, tmp_path):
    found = files.scan(spark, dump(tmp_path)).withColumn("format", files.detect_format(F.col("path"), F.col("content"))).withColumn("format", F.when(F.col("path").endswith("epub"), "epub").otherwise(F.col("format")))
    out = extract.extract(found)
    status = {r.book_key.rpartition("dump/")[2]: r.status for r in out.collect()}
    assert status["a.epub"] == "extracted" and status["k.mobi"] == "needs_conversion" and status["empty.txt"] == "failed"
    rows = extract.blocks(out.where(F.col("book_key").endswith("dump/a.epub"))).orderBy("seq").collect()
    assert [(r.text, r.chapter_idx, r.chapter_title) for r in rows] == [("Intro one", 0, "Intro one"), ("First boldly & well.", 0, "Intro one"), ("The very end.", 1, None)]
    assert [r.char_offset for r in rows] == [0, 10, 0]
    txt = extract.blocks(out.where(F.col("book_key").endswith("notes.txt"))).orderBy("seq").collect()
    assert [(r.text, r.chapter_idx, r.char_offset) for r in txt] == [("Ein Wort.", None, 0), ("Zwei ü", None, 10)]


def test_exploded_book(spark):
    df = spark.createDataFrame([("d", "d/p1.html", 1, bytearray(b"<h2>One</h2><p>first text</p>")), ("d", "d/p2.html", 2, bytearray(b"<p>second text</p><p>third</p>"))], "folder string, path string, position int, content binary")
    rows = extract.exploded_book(df).orderBy("seq").collect()
    assert [(r.seq, r.text, r.chapter_idx, r.chapter_title, r.char_offset) for r in rows] == [(0, "first text", 0, "One", 0), (1, "second text", 1, "p2", 0), (2, "third", 1, "p2", 12)]


def test_ocr_pages_and_languages(spark):
    long = "word " * 12
    assert [b[5] for b in extract.read_pages([long, "x", long], lambda k: long if k == 2 else "")] == [1, 2, 3]
    assert [b[5] for b in extract.read_pages([long, "x"])] == [1]
    df = spark.createDataFrame([("de",), ("xx",), (None,)], "l string")
    assert [r[0] for r in df.select(extract.ocr_language(F.col("l"), {"deu", "eng"})).collect()] == ["deu", "eng", "eng"]


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert sinks.latest_snapshot(spark, root) is None
    for v in (1, 2):
        sinks.write_snapshot(spark.range(v), root, v)
    assert sinks.latest_snapshot(spark, root).count() == 2
    v = spark.createDataFrame([(1, [0.5])], "chunk_id long, embedding array<float>")
    for _ in range(2):
        sinks.append_vectors(v, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").count() == 1


def test_stream_takes_only_what_is_new(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(5).write.parquet(source)
    schema = spark.read.parquet(source).schema
    handle = incremental.keep_unseen(sink, "id")
    incremental.new_rows(spark, source, schema, f"{tmp_path}/c", handle)
    spark.range(3, 9).write.mode("append").parquet(source)
    incremental.new_rows(spark, source, schema, f"{tmp_path}/c", handle)
    incremental.new_rows(spark, source, schema, f"{tmp_path}/c", handle)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(9))


def test_empty_files_are_found(spark, tmp_path):
    for name, raw in {"a.txt": b"", "b.txt": b"x", "d e/f%20g.txt": b"", "d e/h/i.txt": b"", "d e/j.txt": b"y", "d e/_k": b"", ".l": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.path.removeprefix(f"{tmp_path}/"): r.size for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": 0, "b.txt": 1, "d e/f%20g.txt": 0, "d e/h/i.txt": 0, "d e/j.txt": 1}


def test_books_are_settled_under_one_mark(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert sinks.read_work(spark, root, "books") is None
    book = lambda i, t: spark.createDataFrame([(i, t)], "id long, title string")
    block = lambda i, n: spark.range(n).select(F.lit(i).cast("long").alias("id"), F.col("id").alias("seq"))
    sinks.commit_work({"books": book(1, "a"), "blocks": block(1, 3)}, root, 1)
    sinks.commit_work({"books": book(1, "b"), "blocks": block(1, 2)}, root, 2)
    # a version without its mark isn't there
    book(2, "c").write.parquet(f"{root}/books/v=000000003")
    assert [tuple(r) for r in sinks.read_work(spark, root, "books", "id").collect()] == [(1, "b")]
    assert sinks.read_work(spark, root, "blocks", "id").count() == 2 and sinks.read_work(spark, root, "blocks").count() == 5


def test_runs_are_begun_and_ended(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    for i in (1, 2):
        sinks.start_run(spark, path, i, "/dump", False, 3)
    for seen in (9, 10):  # noted twice
        sinks.finish_run(spark, path, 1, seen, 8, 1, 1)
    rows = {r.id: r for r in sinks.runs(spark.read.parquet(f"{path}/started"), spark.read.parquet(f"{path}/finished")).collect()}
    assert rows[1].files_seen == 10 and rows[1].finished_at is not None and rows[2].finished_at is None


def test_text_layers_and_converters():
    long = "word " * 16
    assert [b[5] for b in extract.layered_pages(f"{long}\f{long}\fx", 3)] == [1, 2]
    assert [b[5] for b in extract.layered_pages("too little", 3, lambda k: long if k == 3 else "")] == [3]
    assert extract.layered_pages(None, 0) == []
    read = extract.converting_reader(["cp", "{0}", "{1}"], "doc", "txt")
    assert [b[1] for b in read(b"One.\n\nTwo.")[0]] == ["One.", "Two."]
    for command, why in ((["sleep", "5"], "TimeoutExpired"), (["no-such-program-here"], "FileNotFoundError"), (["false"], "CalledProcessError")):
        with pytest.raises(Exception) as e:
            extract.converting_reader(command, "doc", "txt", timeout=0.3)(b"x")
        assert e.typename == why


def test_pages_of_engines_and_their_timings(spark, tmp_path):
    for engine in ("a", "b c"):
        (tmp_path / engine / "slug").mkdir(parents=True)
        (tmp_path / engine / "slug" / "page_0003.txt").write_text("two\nlines")
    (tmp_path / "a" / "timings.json").write_text('{"pages": {"slug/page_0003": 1.5}}')
    pages = ocr_metrics.page_texts(spark, str(tmp_path))
    assert sorted(tuple(r) for r in pages.collect()) == [("a", "slug", 3, "two\nlines"), ("b c", "slug", 3, "two\nlines")]
    timed = ocr_metrics.with_timings(pages, ocr_metrics.page_timings(spark, str(tmp_path)))
    assert {r.engine: r.seconds for r in timed.collect()} == {"a": 1.5, "b c": None}
