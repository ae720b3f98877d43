"""DuckDB SQL of the queries SQL can express; names and columns are those of the queries."""

from __future__ import annotations

from quire.plans.queries import CANDIDATES, TOP


class _Template(str):
    """A pattern with {0} for its argument; other braces stand for themselves."""

    def format(self, x: str) -> str:
        return self.replace("{0}", x)


SP = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NORM = _Template("trim(regexp_replace({0}, '" + SP + "+', ' ', 'g'), ' ')")
_M = """m AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY surveyed_at DESC NULLS LAST, sha256 NULLS LAST, size, status) AS rn
    FROM files WHERE path IS NOT NULL) WHERE rn = 1)"""
_FIT = _Template(r"CASE WHEN length({0}) > 0 AND NOT regexp_matches(trim({0}), '(?i)^(microsoft (word|powerpoint)|dokument\d*|document\d*|doc\d+|untitled|unbenannt|new document|scan\d*|print|acrobat|slide ?1|präsentation\d*)\b') THEN {0} END")
_TITLE_KEY = _NORM.format("regexp_replace(lower(title), '[(\\[{].*?[)\\]}]|[-_.,;:!?''\"]+', ' ', 'g')")
_EBOOK = "format IN ('pdf','epub','mobi','txt','html','fb2','djvu')"
_USABLE = f"({_EBOOK} AND status = 'ok')"
_B = "b AS (SELECT DISTINCT ON (book_id, seq, text) * FROM blocks)"
_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_PARENT = "CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) WHEN path IS NOT NULL THEN '.' END"
_STEM = f"regexp_replace({_BASE}, '(.)\\.[^.]*$', '\\1')"
_EXT = f"lower(regexp_extract({_BASE}, '.\\.([^.]*)$', 1))"
_TOK = _Template(r"regexp_extract_all({0}, '[\pL\pN]+')")
_FOLD = _Template("strip_accents(lower({0}))")


def _group(key: str, where: str = "true") -> str:
    return f"WITH {_M} SELECT coalesce(nullif({key}, ''), 'unknown') AS {key}, count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM m WHERE {where} GROUP BY 1"


_PAGED = f"{_M.replace('m AS (', 'm0 AS (')}, m AS (SELECT * REPLACE ('html' AS format, ({_PARENT}) || '/page 1' || {_BASE} AS path) FROM m0 WHERE {_USABLE})"
_CAND = f"{_M}, c AS (SELECT * FROM m WHERE sha256 IS NOT NULL AND ((status = 'ok' AND {_EBOOK}) OR format = 'doc'))"
_REPS = f"""{_CAND}, g AS (SELECT sha256, count(*) - 1 AS copies, arg_min(path, (length(path), path)) AS path FROM c GROUP BY 1),
    r AS (SELECT DISTINCT ON (c.sha256, c.path) c.*, copies FROM c JOIN g ON g.sha256 = c.sha256 AND g.path = c.path)"""
_DIRTITLE = """coalesce(list_filter(list_transform(list_reverse(string_split(folder, '/')), lambda n: trim(regexp_replace(n, '^[\\d\\s_.\\-]+', ''))),
    lambda n: n <> '' AND NOT list_contains(['files','file','html','htm','xhtml','text','texts','book','books','ebook','ebooks','chapters','content','contents','data','pages','images','oebps','ops','www','output','export'], lower(n)))[1][1:200],
    list_reverse(string_split(folder, '/'))[1])"""
_DIRS = f"""{_REPS}, h AS (SELECT {_PARENT} AS folder, {_STEM} AS stem FROM r WHERE format = 'html'),
    e0 AS (SELECT folder, count(*) AS files, avg(regexp_matches(stem, '\\d')::INT::DOUBLE) AS digits, min(stem) AS lo, max(stem) AS hi FROM h GROUP BY 1),
    e AS (SELECT folder, files, {_DIRTITLE} AS title FROM e0 WHERE files >= 8 AND (digits >= 0.7 OR len(list_filter(generate_series(1, least(length(lo), length(hi))), lambda i: lo[1:i] = hi[1:i])) >= 6))"""
_ROUTES = f"""{_DIRS}, k AS (SELECT DISTINCT sha256 FROM book_files WHERE role = 'duplicate' AND sha256 IS NOT NULL),
    o AS (SELECT path, sha256, CASE WHEN regexp_matches({_BASE}, '^(~\\$|\\.~lock)') THEN 'lock_artifact' WHEN sha256 IN (SELECT sha256 FROM k) THEN 'already_ingested'
      WHEN format = 'html' AND ({_PARENT}) IN (SELECT folder FROM e) THEN 'exploded_html' WHEN format = 'pdf' AND text_class IN ('text','mixed') THEN 'pdf'
      WHEN (format = 'pdf' AND text_class = 'scanned') OR format = 'djvu' THEN 'register' WHEN format = 'pdf' THEN 'empty_pdf' WHEN format IN ('mobi','doc') THEN 'convert' ELSE format END AS outcome FROM r)"""

_SENT = _Template("list_filter(list_transform(string_split(regexp_replace({0}, '([.!?…])" + SP + "+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^" + SP + "+|" + SP + "+$', '', 'g')), lambda s: s <> '')")
_WORDS = _Template("list_filter(regexp_split_to_array({0}, '" + SP + "+'), lambda w: w <> '')")
_PARAS = _Template("list_filter(list_transform(regexp_split_to_array({0}, '\\n" + SP + "*\\n'), lambda p: " + _NORM.format("p") + "), lambda p: p <> '')")


def _bm25(queries: str, top: int) -> str:
    """CTEs ending in ``ranked`` (query_id, id, score, rank); queries is a CTE body of query_id, query."""
    return f"""q AS ({queries}),
    qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOK.format(_FOLD.format('w'))}) AS term
        FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\pL\\pN_]+')) AS w FROM q)) GROUP BY ALL),
    d AS (SELECT row_number() OVER () AS r, doc_id AS id, {_TOK.format(_FOLD.format('text'))} AS t FROM documents),
    s AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS avgdl FROM d),
    p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    sc AS (SELECT query_id, id, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
        FROM qt JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= {top})"""


def _cosine(order: str, top: int) -> str:
    return f"""SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
        FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) QUALIFY rank <= {top}"""


_DOCQ = "SELECT doc_id AS query_id, coalesce(title, '') AS query FROM documents WHERE doc_id % 100 = 0"
_DENSE = f"""dn AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT q.query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
        FROM q JOIN embeddings a ON a.vec_id = q.query_id, embeddings b) QUALIFY rank <= {CANDIDATES}),
    fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM ranked UNION ALL SELECT * FROM dn) GROUP BY ALL)"""
_HYBRID = f"{_bm25(_DOCQ, CANDIDATES)}, {_DENSE}, hy AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fu QUALIFY rank <= {TOP})"

_PAIRS = """el AS (SELECT * FROM books WHERE minhash IS NOT NULL AND status = 'extracted' AND needs_ocr = false AND word_count >= 500),
    pr AS (SELECT x.id AS a, y.id AS b, len(list_filter(list_zip(x.minhash, y.minhash), lambda z: z[1] = z[2])) AS equal, x.created_at AS ca, y.created_at AS cb FROM el x JOIN el y ON x.id < y.id
        WHERE least(x.word_count, y.word_count) >= 0.5 * greatest(x.word_count, y.word_count)),
    ok AS (SELECT a, b, equal, ca, cb FROM pr WHERE equal >= 77)"""
_PLAN = f"""WITH RECURSIVE {_PAIRS}, ed AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok),
    reach AS (SELECT a AS id, a AS other FROM ed UNION SELECT reach.id, ed.b FROM reach JOIN ed ON ed.a = reach.other),
    comp AS (SELECT id, min(other) AS component FROM reach GROUP BY 1),
    rk AS (SELECT comp.id, component, coalesce(nullif(list_position(['epub','pdf','fb2','html','txt','mobi','doc'], source_format), 0), 10) AS r, word_count FROM comp JOIN books ON books.id = comp.id),
    cn AS (SELECT component, arg_min(id, (r, -word_count, id)) AS canonical FROM rk GROUP BY 1),
    plan AS (SELECT canonical, id AS alternate FROM rk JOIN cn USING (component) WHERE id <> canonical)"""
_ENG = f"""{_B}, pg AS (SELECT book_id::VARCHAR AS slug, seq AS page, min(text) AS text FROM b WHERE page IS NOT NULL GROUP BY ALL),
    en AS (SELECT 'plain' AS engine, slug, page, text FROM pg UNION ALL SELECT 'worse', slug, page, replace(replace(text, 'e', 'c'), 'm', 'rn') FROM pg),
    nm AS (SELECT engine, slug, page, {_NORM.format("translate(nfc_normalize(text), '„“”‚‘’—–', '\"\"\"''''''--')")} AS text FROM en)"""
_GARB = r"[^A-Za-zÀ-ÿĀ-ž0-9\x{0009}-\x{000D} .,;:!?()\[\]\-''\"„“”‚‘’«»&/%§+*=°_—–]"
_SCORES = f"""{_ENG}, dw AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿĀ-ž]{{2,}}'))) AS w FROM documents),
    tk AS (SELECT engine, slug, page, lower(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿĀ-ž]{{2,}}'))) AS w FROM nm),
    dr AS (SELECT engine, slug, page, round(avg((w IN (SELECT w FROM dw))::INT::DOUBLE), 6) AS dict_ratio FROM tk GROUP BY ALL),
    sc AS (SELECT nm.engine, nm.slug, nm.page, length(nm.text)::INT AS chars, round(levenshtein(nm.text, t.text)::DOUBLE / greatest(length(t.text), 1), 6) AS cer, dict_ratio,
        round(CASE WHEN length(nm.text) > 0 THEN length(regexp_replace(nm.text, '{_GARB.replace("[^", "[", 1)}', '', 'g'))::DOUBLE / length(nm.text) END, 6) AS garbage_ratio
        FROM nm LEFT JOIN (SELECT * FROM nm WHERE engine = 'plain') t ON t.slug = nm.slug AND t.page = nm.page LEFT JOIN dr ON dr.engine = nm.engine AND dr.slug = nm.slug AND dr.page = nm.page)"""

_FIX = "CASE WHEN length(f1) > 6 AND regexp_matches(f1, '^[0-9]') THEN regexp_replace(f1, '^[0-9 ]{1,5}', '') ELSE f1 END"
_CNT = _Template("(length(sentence) - length(regexp_replace(sentence, '{0}', '', 'g')))")
_JUDGED = f"""st AS (SELECT doc_id, unnest({_SENT.format('text')}) AS sentence FROM documents),
    s1 AS (SELECT *, {_WORDS.format('sentence')} AS ws, regexp_replace(sentence, '^''', '') AS f1 FROM st),
    s2 AS (SELECT *, translate({_FIX}, '‘’"', '') AS bare FROM s1),
    jd AS (SELECT doc_id, sentence, CASE WHEN len(ws) < 5 THEN 'too_few_words' WHEN len(list_filter(ws, lambda w: length(w) < 2)) * 2 > len(ws) THEN 'too_many_short_words'
      WHEN regexp_matches(bare[1], '[0-9]') THEN 'first_word_is_number' WHEN {_CNT.format('\\(')} >= 3 OR {_CNT.format('\\)')} >= 3 THEN 'brackets'
      WHEN len(list_filter(ws, lambda w: regexp_matches(w, '^[(\\[]?[0-9][0-9.,]*[)\\].,;:!?]*$'))) > 3 THEN 'too_many_numbers' WHEN {_CNT.format(',')} > 6 THEN 'too_many_commas'
      WHEN list_contains(['.', '''', ';', '~', ':', '-', '·', '‘', '’', '\\'], bare[1]) THEN 'begins_with_punctuation' WHEN {_CNT.format('[~\\\\/;:_·<>�!]')} > 3 THEN 'weird_chars'
      WHEN NOT regexp_matches(bare[1], '\\p{{Lu}}') THEN 'first_not_upper' WHEN NOT list_contains(['.', '?', '!'], sentence[-1]) THEN 'last_not_dot' WHEN {_CNT.format('\\.')} > 3 THEN 'too_many_dots' ELSE 'valid' END AS reason FROM s2)"""
_REASONS = ("too_few_words", "too_many_short_words", "first_word_is_number", "brackets", "too_many_numbers", "too_many_commas", "begins_with_punctuation", "weird_chars", "first_not_upper", "last_not_dot", "too_many_dots", "valid")

_SH = r"""dd AS (SELECT DISTINCT book_id * 1000000 + seq AS block_id, regexp_extract_all(lower(text), '\pL+') AS w FROM blocks),
    gg AS (SELECT DISTINCT block_id, hash(list_slice(w, i, i + 4)) AS g FROM (SELECT block_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM dd WHERE len(w) >= 5)),
    kk AS (SELECT block_id, count(*) AS n, list_sort(list(g)) AS k FROM gg GROUP BY 1), cl AS (SELECT block_id, n, min(block_id) OVER (PARTITION BY k) AS rep FROM kk)"""

SQL: dict[str, str] = {
    "survey_latest": f"WITH {_M} SELECT path, size, status, sha256, epoch_us(surveyed_at) AS surveyed_us FROM m",
    "survey_by_format": _group("format"),
    "survey_by_status": _group("status"),
    "survey_languages": _group("language", _USABLE + " AND language <> ''"),
    "text_layer_split": f"WITH {_M} SELECT coalesce(nullif(text_class, ''), 'unknown') AS text_class, count(*) AS files, coalesce(sum(pages), 0)::BIGINT AS pages FROM m WHERE {_EBOOK} GROUP BY 1",
    "exact_duplicates": f"WITH {_M} SELECT sha256, count(*) AS copies, (count(*) - 1) * min(size) AS wasted_bytes, min(path) AS first_path FROM m WHERE sha256 <> '' GROUP BY 1 HAVING count(*) > 1",
    "duplicate_totals": f"WITH {_M} SELECT count(*) AS exact_groups, coalesce(sum(n - 1), 0)::BIGINT AS redundant_files, coalesce(sum((n - 1) * s), 0)::BIGINT AS wasted_bytes FROM (SELECT count(*) AS n, min(size) AS s FROM m WHERE sha256 <> '' GROUP BY sha256 HAVING count(*) > 1)",
    "duplicate_examples": f"WITH {_M} SELECT sha256, path FROM m WHERE sha256 IN (SELECT sha256 FROM m WHERE sha256 <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5)",
    "works_estimate": f"WITH {_M}, t AS (SELECT {_TITLE_KEY} AS k FROM m WHERE {_USABLE}), g AS (SELECT k, count(*) AS n FROM t WHERE length(k) >= 8 GROUP BY 1) SELECT count(*) AS unique_titles, coalesce(sum((n > 1)::INT), 0)::BIGINT AS titles_in_multiple_files FROM g",
    "survey_problems": f"WITH {_M} SELECT status, path, format, error FROM m WHERE status IN ('corrupt','encrypted','drm','error')",
    "survey_problem_counts": f"WITH {_M} SELECT status, count(*) AS files FROM m WHERE status IN ('corrupt','encrypted','drm','error') GROUP BY 1",
    "archive_totals": f"WITH {_M} SELECT count(*) AS archives, coalesce(sum(coalesce(list_sum(map_values(contains)), 0)), 0)::BIGINT AS ebooks_inside FROM m WHERE format IN ('zip','rar','7z') AND status = 'unsupported'",
    "survey_totals": f"WITH {_M} SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes, coalesce(sum(({_EBOOK})::INT), 0)::BIGINT AS ebook_files, coalesce(sum({_USABLE}::INT), 0)::BIGINT AS usable_ebooks, coalesce(sum(({_USABLE} AND coalesce(language, '') = '')::INT), 0)::BIGINT AS unknown_language, coalesce(round(100.0 * sum(({_USABLE} AND coalesce(has_metadata, false))::INT) / nullif(sum({_USABLE}::INT), 0), 1), 0.0)::DOUBLE AS metadata_pct FROM m",
    "size_estimates": f"""WITH {_M}, i AS (SELECT coalesce(sum(word_estimate), 0)::BIGINT AS words_extractable, trunc(coalesce(sum(CASE text_class WHEN 'scanned' THEN coalesce(pages, 0) * 1.0 WHEN 'mixed' THEN coalesce(pages, 0) * 0.5 ELSE 0.0 END), 0))::BIGINT AS scanned_pages FROM m WHERE {_USABLE}),
        j AS (SELECT *, scanned_pages * 300 AS words_from_ocr, words_extractable + scanned_pages * 300 AS words_total FROM i), k AS (SELECT *, trunc(words_total / 300::DOUBLE * 1.15::DOUBLE)::BIGINT AS chunks FROM j),
        l AS (SELECT *, round(chunks * 1174 / 1073741824::DOUBLE, 4) AS vector_ram_gb, round(chunks * 4096 / 1073741824::DOUBLE, 4) AS vector_disk_gb, round(chunks / 8::DOUBLE / 3600, 4) AS embed_hours, round(scanned_pages / 1::DOUBLE / 3600, 4) AS ocr_hours FROM k)
        SELECT *, CASE WHEN vector_ram_gb < 32 THEN 'comfortable' WHEN vector_ram_gb < 51.2 THEN 'tight' ELSE 'on disk' END AS ram_fit,
        CASE WHEN embed_hours < 1 THEN printf('%.0f min', embed_hours * 60) WHEN embed_hours < 48 THEN printf('%.1f h', embed_hours) ELSE printf('%.1f days', embed_hours / 24) END AS embed_time,
        CASE WHEN ocr_hours < 1 THEN printf('%.0f min', ocr_hours * 60) WHEN ocr_hours < 48 THEN printf('%.1f h', ocr_hours) ELSE printf('%.1f days', ocr_hours / 24) END AS ocr_time FROM l""",
    "runs_with_files": f"WITH {_M} SELECT runs.id, count(path) AS files FROM runs LEFT JOIN m ON surveyed_at BETWEEN started_at AND finished_at WHERE finished_at IS NOT NULL GROUP BY 1",
    "format_magic": f"""WITH {_M}, x AS (SELECT path, format, {_EXT} AS e FROM m) SELECT path, CASE WHEN e IN ('cbz','cbr') THEN 'comic' WHEN e IN ('doc','docx','rtf','odt','ppt','pptx','odp','chm') THEN 'doc' WHEN e IN ('txt','text','md','markdown','rst') THEN 'txt' WHEN e = 'fb2' THEN 'fb2' WHEN e IN ('html','htm','xhtml') THEN 'html' WHEN e IN ('mobi','azw','azw3') THEN 'mobi' WHEN e = 'epub' THEN 'zip' WHEN e IN ('pdf','djvu') THEN e ELSE 'other' END AS by_name,
        CASE WHEN e IN ('cbz','cbr') THEN 'comic' WHEN e IN ('doc','docx','rtf','odt','ppt','pptx','odp','chm') THEN 'doc' WHEN format IN ('pdf','djvu','rar','7z','mobi') THEN format WHEN format IN ('epub','zip') THEN 'zip'
        WHEN e IN ('txt','text','md','markdown','rst') THEN 'txt' WHEN format = 'fb2' OR e = 'fb2' THEN 'fb2' WHEN e IN ('html','htm','xhtml') THEN 'html' WHEN e = 'epub' THEN 'zip' WHEN e IN ('mobi','azw','azw3') THEN 'mobi' WHEN e IN ('pdf','djvu') THEN e ELSE 'other' END AS by_content FROM x""",
    "representatives": f"WITH {_REPS} SELECT sha256, path, copies FROM r",
    "plan_routing": f"WITH {_ROUTES} SELECT path, sha256, outcome FROM o",
    "plan_routing_pages": f"WITH {_ROUTES.replace(_M, _PAGED, 1)} SELECT path, sha256, outcome FROM o",
    "scanned_files": "SELECT coalesce(source, 'none') || '-' || coalesce(lang, 'none') AS k, sum(octet_length(encode(coalesce(text, ''))) + 2)::BIGINT AS size, 'txt' AS format, 'ok' AS status, CASE WHEN bool_or(trim(text) <> '') THEN 'text' ELSE 'empty' END AS text_class, true AS hashed FROM documents GROUP BY 1",
    "extracted_files": f"SELECT coalesce(source, 'none') || '-' || coalesce(lang, 'none') AS k, sum(len(p))::BIGINT AS blocks, sum(list_sum(list_transform(p, lambda x: len({_WORDS.format('x')}))))::BIGINT AS words FROM (SELECT source, lang, {_PARAS.format('text')} AS p FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING sum(len(p)) > 0",
    "highlights": r"""WITH x AS (SELECT doc_id, CASE WHEN length(text) > 360 THEN text[1:360] || '…' ELSE text END AS e, coalesce(regexp_extract_all(lower(title), '[\pL\pN_]+'), []) AS q FROM documents)
        SELECT doc_id, CASE WHEN e IS NOT NULL THEN array_to_string(list_transform(regexp_extract_all(e, '[\pL\pN_]+|[^\pL\pN_]+'), lambda p: CASE WHEN list_contains(q, lower(p)) THEN '<mark>' ELSE '' END
        || replace(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), chr(39), '&#39;') || CASE WHEN list_contains(q, lower(p)) THEN '</mark>' ELSE '' END), '') END AS marked FROM x""",
    "plan_counts": f"WITH {_ROUTES} SELECT outcome, count(*) AS files FROM o GROUP BY 1",
    "incremental_anti_join": f"WITH {_CAND} SELECT DISTINCT sha256 FROM c WHERE sha256 NOT IN (SELECT sha256 FROM book_files WHERE sha256 IS NOT NULL)",
    "changed_files": f"WITH {_M}, old AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY surveyed_at DESC NULLS LAST, sha256 NULLS LAST, size, status) AS rn FROM files WHERE path IS NOT NULL AND surveyed_at < TIMESTAMPTZ '2023-09-01 00:00:00+00') WHERE rn = 1) SELECT path, size, mtime_ns, probe_version FROM m WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.path = m.path AND old.size = m.size AND old.mtime_ns = m.mtime_ns AND old.probe_version = m.probe_version)",
    "exploded_dirs": f"WITH {_DIRS.replace(_M, _PAGED, 1)} SELECT folder, files, title FROM e",
    "dir_titles": f"WITH {_M}, x AS (SELECT DISTINCT {_PARENT} AS folder FROM m) SELECT folder, {_DIRTITLE} AS title FROM x",
    "member_order": f"WITH {_DIRS.replace(_M, _PAGED, 1)}, n AS (SELECT {_PARENT} AS folder, path, array_to_string(list_transform(regexp_extract_all(lower(path), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '') AS key FROM r WHERE format = 'html'), o AS (SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY key, path)::INT AS position FROM n WHERE folder IN (SELECT folder FROM e)) SELECT *, CASE WHEN position = 1 THEN 'primary' ELSE 'member' END AS role FROM o",
    "books_listing": "SELECT id, title, author, status, coalesce(n, 0) AS files FROM books LEFT JOIN (SELECT book_id, count(sha256) AS n FROM (SELECT DISTINCT ON (sha256) * FROM book_files) GROUP BY 1) f ON f.book_id = id",
    "books_search": "SELECT id, title, author, status, coalesce(n, 0) AS files FROM books LEFT JOIN (SELECT book_id, count(sha256) AS n FROM (SELECT DISTINCT ON (sha256) * FROM book_files) GROUP BY 1) f ON f.book_id = id WHERE status = 'extracted' AND (lower(coalesce(title, '')) LIKE '%history%' OR lower(coalesce(author, '')) LIKE '%history%')",
    "awaiting_queue": "SELECT id, language, p.path FROM books JOIN (SELECT book_id, min(path) AS path FROM book_files WHERE role = 'primary' GROUP BY 1) p ON p.book_id = id WHERE status = 'awaiting_ocr'",
    "primary_paths": "SELECT book_id, min(path) AS path FROM book_files WHERE role = 'primary' GROUP BY 1",
    "books_without_blocks": "SELECT id, block_count FROM books WHERE block_count > 0 AND id NOT IN (SELECT book_id FROM blocks WHERE book_id IS NOT NULL AND page IS NOT NULL)",
    "book_text_counts": "SELECT book_id, sum(word_count)::BIGINT AS words, count(*) AS blocks FROM (SELECT DISTINCT ON (book_id, seq) * FROM blocks) GROUP BY 1",
    "catalog_totals": "SELECT count(*) AS books, coalesce(sum(word_count), 0)::BIGINT AS words FROM books",
    "ingest_outcomes": "SELECT status, count(*) AS books, coalesce(sum(word_count), 0)::BIGINT AS words, coalesce(sum(block_count), 0)::BIGINT AS blocks FROM books GROUP BY 1",
    "retryable_books": "SELECT id, title FROM books WHERE status = 'needs_conversion' AND id NOT IN (SELECT book_id FROM book_files WHERE lower(path) LIKE '%.chm')",
    "book_show": "SELECT DISTINCT book_id, seq, text FROM blocks WHERE book_id = 2 AND seq IN (SELECT DISTINCT seq FROM blocks WHERE book_id = 2 ORDER BY seq LIMIT 3)",
    "manifest_upsert": "SELECT path, epoch_us(max(surveyed_at)) AS surveyed_us FROM files WHERE path IS NOT NULL GROUP BY 1",
    "quality_scores": "SELECT doc_id, round(CASE WHEN length(text) > 0 THEN 1 - length(regexp_replace(text, '[\\pL\\pN_ .,;:!?()''\"\\-–—\\t\\n\\r\\f\\x{000B}]', '', 'g'))::DOUBLE / length(text) ELSE 0 END, 6) AS quality FROM documents",
    "word_counts": f"WITH {_B} SELECT book_id, seq, coalesce(len({_WORDS.format('text')}), 0)::INT AS words FROM b",
    "clean_pages": f"WITH {_B} SELECT book_id, seq, {_NORM.format(f"regexp_replace(text, '([\\pL\\pN_])-{SP}*\\n{SP}*([\\pL\\pN_])', '\\1\\2', 'g')")} AS text FROM b WHERE page IS NOT NULL",
    "paragraphs": f"WITH {_B}, x AS (SELECT book_id, seq, text, {_PARAS.format('text')} AS p FROM b) SELECT book_id, seq, i::INT - 1 AS pos, p[i] AS paragraph FROM (SELECT book_id, seq, p, unnest(generate_series(1, len(p))) AS i FROM x)",
    "sentences": f"WITH x AS (SELECT doc_id, {_SENT.format('text')} AS s FROM documents) SELECT doc_id, i::INT - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM x)",
    "strip_html": f"SELECT doc_id, {_NORM.format("coalesce(title, '') || ' ' || coalesce(text, '')")} AS text FROM documents",
    "titles_from_names": f"WITH {_M} SELECT path, {_NORM.format(f"regexp_replace({_STEM}, '[_.]+', ' ', 'g')")}[1:200] AS title, {_EXT} AS ext FROM m",
    "title_keys": f"SELECT id, {_TITLE_KEY} AS title_key FROM books",
    "language_labels": "SELECT id, nullif(split_part(split_part(lower(trim(language)), '-', 1), '_', 1), '') AS language FROM books",
    "locators": f"WITH {_B} SELECT book_id, seq, coalesce('p. ' || page::VARCHAR, CASE WHEN chapter_idx IS NOT NULL THEN coalesce(chapter_title, 'chapter ' || (chapter_idx + 1)::VARCHAR) END, 'text') AS block, coalesce('pp. ' || page::VARCHAR || '–' || (page + 1)::VARCHAR, chapter_title, 'chapter ' || (chapter_idx + 1)::VARCHAR, 'text') AS passage FROM b",
    "excerpts": "SELECT doc_id, CASE WHEN length(text) > 400 THEN text[1:400] || '…' ELSE text END AS excerpt FROM documents",
    "garbage_ratios": f"WITH {_B} SELECT book_id, seq, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '{_GARB.replace("[^", "[", 1)}', '', 'g'))::DOUBLE / length(text) END, 6) AS garbage FROM b",
    "natural_order": f"WITH {_M} SELECT path, array_to_string(list_transform(regexp_extract_all(lower(path), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '') AS key FROM m",
    "sentence_reasons": f"WITH {_JUDGED} SELECT reason, count(*) AS sentences FROM jd GROUP BY 1",
    "sentence_histogram": f"WITH {_JUDGED} SELECT doc_id, " + ", ".join(f"sum((reason = '{r}')::INT)::BIGINT AS {r}" for r in _REASONS) + " FROM jd GROUP BY 1",
    "chapter_runs": "WITH b AS (SELECT DISTINCT ON (book_id, seq) book_id, seq, chapter_idx FROM blocks), c AS (SELECT *, (row_number() OVER w = 1 OR chapter_idx IS DISTINCT FROM lag(chapter_idx) OVER w)::INT AS new FROM b WINDOW w AS (PARTITION BY book_id ORDER BY seq)), r AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY seq)::BIGINT AS run FROM c) SELECT book_id, run, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS blocks FROM r GROUP BY ALL",
    "char_offsets": f"WITH {_B}, x AS (SELECT book_id, seq, text, {_PARAS.format('text')} AS p FROM b) SELECT book_id, seq, i::INT - 1 AS pos, coalesce(list_sum(list_transform(p[1:i - 1], lambda t: length(t) + 1)), 0)::BIGINT AS char_offset FROM (SELECT book_id, seq, p, unnest(generate_series(1, len(p))) AS i FROM x)",
    "postings_stats": f"SELECT term, count(DISTINCT r) AS df, count(*) AS cf FROM (SELECT r, unnest({_TOK.format(_FOLD.format('text'))}) AS term FROM (SELECT doc_id AS r, text FROM documents)) GROUP BY 1",
    "postings_after_changes": f"SELECT term, count(DISTINCT r) AS df, count(*) AS cf FROM (SELECT r, unnest({_TOK.format(_FOLD.format('text'))}) AS term FROM (SELECT doc_id AS r, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE title IS NULL AND doc_id IS NOT NULL))) GROUP BY 1",
    "survey_recommendations": f"""WITH {_M}, s AS (SELECT count(*) FILTER (format = 'doc') AS office, count(*) FILTER ({_USABLE}) AS usable, count(*) FILTER ({_EBOOK} AND text_class = 'scanned') AS scanned, count(*) FILTER ({_USABLE} AND coalesce(language, '') = '') AS unknown,
        count(*) FILTER (format IN ('zip','rar','7z') AND status = 'unsupported') AS archives, coalesce(sum(word_estimate) FILTER ({_USABLE}), 0) AS w, trunc(coalesce(sum(CASE text_class WHEN 'scanned' THEN coalesce(pages, 0) * 1.0 WHEN 'mixed' THEN coalesce(pages, 0) * 0.5 ELSE 0.0 END) FILTER ({_USABLE}), 0)) AS p FROM m),
        d AS (SELECT coalesce(sum(n - 1), 0) AS redundant, coalesce(sum((n - 1) * z), 0) AS wasted FROM (SELECT count(*) AS n, min(size) AS z FROM m WHERE sha256 <> '' GROUP BY sha256 HAVING count(*) > 1)),
        x AS (SELECT *, round(trunc((w + p * 300) / 300::DOUBLE * 1.15::DOUBLE) * 1174 / 1073741824::DOUBLE, 4) AS ram FROM s, d),
        y AS (SELECT 'convert_office' AS topic, office::DOUBLE AS amount FROM x WHERE office > 0 UNION ALL SELECT 'recognise_scans', scanned FROM x WHERE usable > 0 AND scanned / greatest(usable, 1)::DOUBLE > 0.25 UNION ALL SELECT 'index_on_disk', ram FROM x WHERE ram > 32
        UNION ALL SELECT 'skip_copies', redundant FROM x WHERE wasted > 5368709120 UNION ALL SELECT 'unpack_archives', archives FROM x WHERE archives > 0 UNION ALL SELECT 'detect_languages', unknown FROM x WHERE usable > 0 AND unknown / greatest(usable, 1)::DOUBLE > 0.3)
        SELECT * FROM y UNION ALL SELECT 'proceed', 0.0 WHERE NOT EXISTS (SELECT 1 FROM y)""",
    "awaiting_first": "SELECT id, language, p.path FROM books JOIN (SELECT book_id, min(path) AS path FROM book_files WHERE role = 'primary' GROUP BY 1) p ON p.book_id = id WHERE status = 'awaiting_ocr' ORDER BY id LIMIT 5",
    "final_titles": f"""WITH {_M}, pp AS (SELECT book_id, min(path) AS path FROM book_files WHERE role = 'primary' GROUP BY 1), w AS (SELECT books.id AS book_id, books.title, books.author, books.language, pp.path, m.title AS st, m.author AS sa, m.language AS sl FROM books LEFT JOIN pp ON pp.book_id = books.id LEFT JOIN m ON m.path = pp.path),
        b AS (SELECT DISTINCT ON (book_id, seq) book_id, seq, text FROM blocks WHERE text IS NOT NULL), t AS (SELECT book_id, string_agg(text, ' ' ORDER BY seq)[1:12000] AS x FROM b GROUP BY 1),
        s AS (SELECT book_id, round(CASE WHEN length(x) > 0 THEN 1 - length(regexp_replace(x, '[\\pL\\pN_ .,;:!?()''"\\-–—\\t\\n\\r\\f\\x{{000B}}]', '', 'g'))::DOUBLE / length(x) ELSE 0 END, 3) AS quality FROM t)
        SELECT w.book_id, coalesce({_FIT.format('w.title')}, {_FIT.format('w.st')}, {_NORM.format(f"regexp_replace({_STEM}, '[_.]+', ' ', 'g')")}[1:200]) AS title, coalesce(w.author, w.sa) AS author, coalesce(w.language, w.sl) AS language, coalesce(quality, 0.0) AS quality FROM w LEFT JOIN s ON s.book_id = w.book_id""",
    "hydrate_works": f"""WITH {_bm25("SELECT id AS query_id, coalesce(title, '') AS query FROM books WHERE id % 100 = 0", TOP).replace("doc_id AS id", "book_id * 1000000 + seq AS id").replace("FROM documents", "FROM (SELECT DISTINCT ON (book_id, seq) book_id, seq, text FROM blocks)")}, pp AS (SELECT book_id, min(path) AS path FROM book_files WHERE role = 'primary' GROUP BY 1)
        SELECT query_id, r.id, rank, score, b.id AS book_id, (r.id % 1000000)::INT AS seq, title, author, language, path FROM ranked r JOIN books b ON b.id = r.id // 1000000 LEFT JOIN pp ON pp.book_id = b.id""",
    "bm25_topk": f"WITH {_bm25(_DOCQ, TOP)} SELECT query_id, id, score, rank FROM ranked",
    "hydrate": f"WITH {_bm25(_DOCQ, TOP)} SELECT query_id, id, score, rank, title, source, CASE WHEN length(text) > 400 THEN text[1:400] || '…' ELSE text END AS excerpt FROM ranked JOIN documents ON doc_id = id",
    "cosine_topk": _cosine("DESC", TOP),
    "cosine_bottomk": _cosine("ASC", 100),
    "rrf_fusion": f"WITH {_bm25(_DOCQ, CANDIDATES)}, {_DENSE} SELECT query_id, id, score FROM fu",
    "hybrid_search": f"WITH {_bm25(_DOCQ, CANDIDATES)}, {_DENSE} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fu QUALIFY rank <= {TOP}",
    "substring_find": f"WITH {_M} SELECT path FROM m WHERE lower({_BASE}) LIKE '%history%'",
    "reachable": f"WITH {_B}, g AS (SELECT * FROM (VALUES (1, 2, NULL, NULL), (2, NULL, 'history', 'harbour'), (3, NULL, 'rydanez', NULL), (4, NULL, 'no such title', NULL), (5, 3, NULL, 'no such phrase'), (6, NULL, 'l_ ', NULL)) v(case_id, book_id, book_match, must_contain)), f AS (SELECT DISTINCT case_id FROM g JOIN books ON CASE WHEN g.book_id IS NOT NULL THEN books.id = g.book_id ELSE lower(title) LIKE lower('%' || book_match || '%') OR lower(author) LIKE lower('%' || book_match || '%') END JOIN b ON b.book_id = books.id WHERE must_contain IS NULL OR contains(lower({_NORM.format("b.text")}), lower(must_contain))) SELECT case_id, case_id IN (SELECT case_id FROM f) AS reachable FROM g",
    "eval_first_ranks": f"WITH {_HYBRID} SELECT q.query_id::INT AS case_id, coalesce(min(CASE WHEN id = q.query_id THEN rank END), 0) AS rank FROM q LEFT JOIN hy ON hy.query_id = q.query_id GROUP BY 1",
    "eval_hit_mrr": f"WITH {_HYBRID}, r AS (SELECT q.query_id, min(CASE WHEN id = q.query_id THEN rank END) AS rank FROM q LEFT JOIN hy ON hy.query_id = q.query_id GROUP BY 1) SELECT count(*) AS cases, count(rank) AS hits, coalesce(round(count(rank) / nullif(count(*), 0)::DOUBLE, 6), 0) AS hit_rate, coalesce(round(avg(coalesce(1 / rank::DOUBLE, 0)), 6), 0) AS mrr FROM r",
    "merge_pairs": f"WITH {_PAIRS} SELECT a, b, equal FROM ok",
    "merge_pairs_new": f"WITH {_PAIRS} SELECT a, b, equal FROM ok WHERE ca >= TIMESTAMPTZ '2024-01-01 00:00:00+00' OR cb >= TIMESTAMPTZ '2024-01-01 00:00:00+00'",
    "merge_plan": f"{_PLAN} SELECT canonical, alternate FROM plan",
    "merged_files": f"{_PLAN} SELECT DISTINCT sha256, coalesce(canonical, book_id) AS book_id, CASE WHEN canonical IS NOT NULL AND role IS DISTINCT FROM 'duplicate' THEN 'alternate_format' ELSE role END AS role FROM book_files LEFT JOIN plan ON alternate = book_id",
    "components": "WITH d AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS component, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE text <> '') SELECT id, component FROM d WHERE n > 1",
    "shingle_jaccard_pairs": f"WITH {_SH}, rp AS (SELECT gg.block_id, g, n FROM gg JOIN cl ON cl.block_id = gg.block_id WHERE rep = cl.block_id), cm AS (SELECT x.block_id AS a, y.block_id AS b, count(*) AS common, x.n + y.n - count(*) AS al FROM rp x JOIN rp y ON x.g = y.g AND x.block_id < y.block_id GROUP BY x.block_id, y.block_id, x.n, y.n) SELECT a, b, common, round(common / al::DOUBLE, 6) AS jaccard FROM cm WHERE common * 1000 >= 800 * al",
    "shingle_classes": f"WITH {_SH} SELECT block_id, rep FROM cl",
    "page_scores": f"WITH {_SCORES} SELECT engine, slug, page, chars, cer, dict_ratio, garbage_ratio FROM sc",
    "engine_means": f"WITH {_SCORES} SELECT engine, slug, round(avg(cer) + 1e-10, 6) AS cer, round(avg(dict_ratio) + 1e-10, 6) AS dict_ratio, round(avg(garbage_ratio) + 1e-10, 6) AS garbage_ratio, count(*) AS pages FROM sc GROUP BY GROUPING SETS ((engine, slug), (engine))",
    "cer_pairs": f"WITH {_ENG} SELECT 'plain' AS first, 'worse' AS second, count(*) AS pages, round(avg(levenshtein(a.text, b.text)::DOUBLE / greatest(length(b.text), 1)), 6) AS cer FROM nm a JOIN nm b ON a.slug = b.slug AND a.page = b.page WHERE a.engine = 'plain' AND b.engine = 'worse'",
}
