"""Queries of the line filters, blocks and chunks.

The documents table stands in for page text: a source is a document and its
rows, in id order, are the pages.  ``page_number_lines``, ``glyph_lines`` and
``heading_detection`` put every line into all forms that their rules know; the
``document_`` queries run the same rules over the lines as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import chunks, ingestion, lines
from ..sources import files
from ..storage import once, written

# Lines made of a line's begin, its page and its number, in every form that the rules know.
NUMBERED = ("{page}", "Halaman {page}", "hal. {no}", "- {page} -", "{roman}", "{roman}ab", "{begin} {page}", "(cid:{page}){begin}", "Halaman {begin}", "{begin}")
HEADED = ("BAB {page} {begin}", "Bagian {page} {begin}", "LAMPIRAN {begin}", "Pasal {page} {begin}", "{page}.{no} {begin}", "{page}.{no}.1 {begin}", "A. {caps}", "a. {begin}", "{caps}", "NO. {caps}", "{caps} /", "KODE {page} {caps}", "({caps}", "{begin}")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _forms(spark, sf, forms):
    """Every line of the table in each of ``forms``."""
    begin = F.substring("line", 1, 40)
    parts = {"page": F.col("page").cast("string"), "no": F.col("line_no").cast("string"), "begin": begin, "caps": F.translate(begin, LETTERS, LETTERS.upper()), "roman": F.substring(F.lit("mdclxvi"), F.lit(1), F.pmod("page", F.lit(7)).cast("int") + 1)}
    made = lambda form: F.concat(*[parts[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", form) if x])
    return _lines(spark, sf).select("source_document", "page", "line_no", F.posexplode(F.array(*map(made, forms))).alias("form", "line")).withColumn("form", F.col("form").cast("long"))


def _lines(spark, sf):
    return lines.lines_of(lines.pages_of(spark.read.parquet(f"{sf}/documents.parquet")))


def line_explode(spark, sf):
    return _lines(spark, sf).groupBy("source_document", "page").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def short_lines(spark, sf):
    rows = _lines(spark, sf).withColumn("n_alnum", lines.alnum_count(F.col("line")).cast("long"))
    return rows.filter(F.col("n_alnum") < C.MIN_ALNUM).select("source_document", "page", "line_no", "line", "n_alnum")


def page_number_lines(spark, sf):
    return _forms(spark, sf, NUMBERED).select("source_document", "page", "line_no", "form", lines.is_page_number(F.col("line")).alias("is_page_number"))


def glyph_lines(spark, sf):
    return _forms(spark, sf, NUMBERED).select("source_document", "page", "line_no", "form", F.col("line").rlike(lines.GLYPH).alias("is_glyph"))


def gibberish_lines(spark, sf):
    return _lines(spark, sf).filter(lines.is_gibberish(F.col("line"))).select("source_document", "page", "line_no", "line")


def header_footer_templates(spark, sf):
    return lines.running_templates(_lines(spark, sf))


def line_filter_report(spark, sf):
    return lines.report(lines.with_reasons(_lines(spark, sf)))


def noisy_pages(spark, sf):
    return lines.noisy_pages(lines.with_reasons(_lines(spark, sf)))


def clean_pages(spark, sf):
    kept = lines.clean_pages(lines.pages_of(spark.read.parquet(f"{sf}/documents.parquet")))
    return kept.select("source_document", "page", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def short_line_limit(spark, sf):
    return chunks.short_line_limit(_lines(spark, sf)).select("source_document", F.round("short_limit", 6).alias("short_limit"))


def heading_detection(spark, sf):
    level, structural = chunks.heading(F.col("line"))
    return _forms(spark, sf, HEADED).select("source_document", "page", "line_no", "form", level.cast("long").alias("level"), structural.alias("structural"))


def document_page_numbers(spark, sf):
    return _lines(spark, sf).filter(lines.is_page_number(F.col("line"))).select("source_document", "page", "line_no", "line")


def document_glyph_lines(spark, sf):
    return _lines(spark, sf).filter(F.col("line").rlike(lines.GLYPH)).select("source_document", "page", "line_no", "line")


def document_headings(spark, sf):
    level, structural = chunks.heading(F.col("line"))
    return _lines(spark, sf).select("source_document", "page", "line_no", "line", level.cast("long").alias("level"), structural.alias("structural")).filter("level is not null")


def paragraph_blocks(spark, sf):
    rows = chunks.paragraph_starts(_lines(spark, sf))
    return rows.groupBy("source_document", "block_no").agg(F.count("*").alias("n_lines"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum(F.length("line")).alias("n_chars"))


def _chunks(spark, sf):
    """Labelled chunks of the whole table, folded once an application."""
    return once(spark, f"{sf}/documents.parquet", "chunks", lambda: written(chunks.with_labels(chunks.chunk_lines(_lines(spark, sf))), "labelled"))


def _digest(column: str):
    return F.md5(F.col(column).cast("binary"))


def chunk_documents(spark, sf):
    pages = F.array_join(F.col("page_numbers").cast("array<string>"), ",")
    return _chunks(spark, sf).select("chunk_index", "source_document", "page_label", "page_start", "page_end", "char_count", "estimated_tokens", pages.alias("pages"), "section_title", "heading_path_label", "document_label", _digest("text").alias("digest"), _digest("embed_text").alias("embed_digest"), _digest("index_text").alias("index_digest"))


def chunk_stats(spark, sf):
    return chunks.chunk_statistics(_chunks(spark, sf))


def source_documents(spark, sf):
    return chunks.source_documents(_chunks(spark, sf))


def chunk_sections(spark, sf):
    return chunks.sections(_chunks(spark, sf))


def explorer_search(spark, sf):
    """The first fifty chunks that hold a term with a sign that a pattern would read otherwise."""
    return chunks.explore(_chunks(spark, sf), "a.").select("chunk_index", "source_document", "page_label")


def _prepared(spark, sf):
    """Chunks and records of the cleaned pages; a document's fingerprint is that of its name here."""

    def build():
        pages = lines.pages_of(spark.read.parquet(f"{sf}/documents.parquet"))
        names = pages.select(F.col("source_document").alias("name")).distinct()
        prints = names.select("name", F.lit("").alias("path"), F.length("name").cast("long").alias("length"), F.sha2("name", 256).alias("sha256"))
        made, records = ingestion.prepare_chunks(pages, prints)
        return made, written(records, "records")

    return once(spark, sf, "prepared", build)


def prepared_chunks(spark, sf):
    return _prepared(spark, sf)[0].select("chunk_index", "source_document", "page_label", "char_count", _digest("text").alias("digest"))


def document_records(spark, sf):
    dropped = F.array_join(F.array_sort(F.transform(F.map_entries("dropped"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ",")
    return _prepared(spark, sf)[1].withColumn("dropped", dropped)


def index_record(spark, sf):
    made, records = _prepared(spark, sf)
    info = files.index_info(made, records, 64, C.CHUNK_SIZE, C.CHUNK_OVERLAP)
    return info.select("pipeline_version", F.size("source_documents").cast("long").alias("n_listed"), "stats.*", F.col("chunking.size").alias("chunk_size"), F.col("chunking.overlap").alias("chunk_overlap"))


def drop_reasons(spark, sf):
    return lines.most_common_reasons(lines.with_reasons(_lines(spark, sf)))


def noisiest_pages(spark, sf):
    return lines.noisiest_pages(lines.with_reasons(_lines(spark, sf)))


def table_lines(spark, sf):
    """The suppliers of each nation as a table of text: some cells are empty, some rows wholly."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet")
    cells = F.when(F.col("s_acctbal") < 0, F.array(F.lit(None).cast("string"), F.lit(" "))).otherwise(F.array(F.col("s_name"), F.when(F.col("s_acctbal") > 5000, F.concat(F.lit(" "), F.col("s_suppkey").cast("string")))))
    tables = rows.groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", cells.alias("cells")))).alias("rows"))
    return tables.select("nation", files.table_text(F.transform("rows", lambda r: r["cells"])).alias("text"))


def chunk_noise(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", chunks.looks_like_noise(F.coalesce("text", F.lit(""))).alias("is_noise"))


def corpus_summary(spark, sf):
    return chunks.corpus_summary(_chunks(spark, sf))


def build_stats(spark, sf):
    return chunks.document_pages(_chunks(spark, sf))


def page_ranges(spark, sf):
    """Pages of each document that hold a line of six words at most, as ranges."""
    short = _lines(spark, sf).filter(F.size(F.split("line", " ")) <= 6).groupBy("source_document").agg(F.collect_set("page").alias("pages"))
    return chunks.page_ranges(short, "source_document", "pages")


QUERIES = {f.__name__: f for f in (line_explode, short_lines, page_number_lines, glyph_lines, gibberish_lines, header_footer_templates, line_filter_report, noisy_pages, clean_pages, short_line_limit, heading_detection, document_page_numbers, document_glyph_lines, document_headings, paragraph_blocks, chunk_documents, chunk_stats, source_documents, chunk_sections, explorer_search, prepared_chunks, document_records, index_record, drop_reasons, noisiest_pages, table_lines, chunk_noise, corpus_summary, build_stats, page_ranges)}

_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LINES = rf"""pg AS (SELECT source AS source_document, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, coalesce(text, '') AS text FROM documents),
        parts AS (SELECT source_document, page, string_split(text, chr(10)) AS p FROM pg),
        raw AS (SELECT source_document, page, unnest(p) AS r, unnest(range(len(p))) AS line_no FROM parts),
        li AS (SELECT source_document, page, line_no, regexp_replace(r, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS line FROM raw WHERE regexp_replace(r, '^{_SPACE}+|{_SPACE}+$', '', 'g') <> '')"""
_PARTS = {"page": "CAST(page AS VARCHAR)", "no": "CAST(line_no AS VARCHAR)", "begin": "left(line, 40)", "caps": f"translate(left(line, 40), '{LETTERS}', '{LETTERS.upper()}')", "roman": "left('mdclxvi', page % 7 + 1)"}


def _fx(forms) -> str:
    """A CTE ``fx`` of every line in each form."""
    made = lambda form: " || ".join(_PARTS[x[1:-1]] if x.startswith("{") else f"'{x}'" for x in re.split(r"(\{\w+\})", form) if x)
    return "fx AS (" + " UNION ALL ".join(f"SELECT source_document, page, line_no, CAST({i} AS BIGINT) AS form, {made(f)} AS line FROM li" for i, f in enumerate(forms)) + ")"


def _run(word: str) -> str:
    out = f"lower({word})"
    for c in C.CONSONANT_CLUSTERS:
        out = f"replace({out}, '{c}', 'c')"
    return f"list_max(list_transform(string_split_regex({out}, '[aeiou]'), lambda s: length(s)))"


_TRIPLED = " + ".join(f"len(regexp_extract_all(line, '{x}{{3}}'))" for c in "abcdefghijklmnopqrstuvwxyz" for x in (c, c.upper()))
_WORDS = f"list_filter(regexp_extract_all(line, '[A-Za-z]+'), lambda w: length(w) >= {C.GIBBERISH_WORD_LENGTH} AND w <> upper(w))"
_GIBBERISH = f"(({_TRIPLED}) >= 2 OR (len({_WORDS}) >= {C.GIBBERISH_WORDS} AND len(list_filter({_WORDS}, lambda w: {_run('w')} >= {C.CONSONANT_RUN})) >= {C.GIBBERISH_RATIO} * len({_WORDS})))"
_EDGE = r"([^\p{L}\p{N}_]|^)[ivxlcdm]{1,7}([^\p{L}\p{N}_]|$)"
_TEMPLATE = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '\d+', '#', 'g'), '{_EDGE}', '\1#\2', 'g'), '{_EDGE}', '\1#\2', 'g'), '\s+', ' ', 'g'))"
_ALNUM = r"length(regexp_replace(line, '[^\p{L}\p{N}]', '', 'g'))"
_PAGE_NUMBER = " OR ".join(f"regexp_matches(line, '{p}')" for p in lines.PAGE_NUMBER)
_TEMPLATES = f"""tl AS (SELECT *, {_TEMPLATE} AS template FROM li),
        ed AS (SELECT *, row_number() OVER (PARTITION BY source_document, page ORDER BY line_no) AS a, row_number() OVER (PARTITION BY source_document, page ORDER BY line_no DESC) AS z FROM tl),
        np AS (SELECT source_document, count(DISTINCT page) AS pages FROM li GROUP BY ALL),
        tp AS (
            SELECT source_document, template, count(*) AS n FROM (SELECT DISTINCT source_document, page, line, template FROM ed WHERE (a <= 2 OR z <= 2) AND length(line) <= {C.TEMPLATE_LENGTH})
            JOIN np USING (source_document) GROUP BY source_document, template, pages
            HAVING pages >= {C.TEMPLATE_PAGES} AND count(*) >= greatest({C.TEMPLATE_PAGES}, floor(1e-1 * pages)) AND template <> '')"""
_REASONS = rf"""{_TEMPLATES},
        rs AS (
            SELECT t.source_document, t.page, t.line_no, regexp_replace(line, '{_SPACE}+', ' ', 'g') AS norm,
                   CASE WHEN regexp_matches(line, '\(cid:\d+\)') THEN 'glyph_code' WHEN {_PAGE_NUMBER} THEN 'page_number' WHEN tp.template IS NOT NULL THEN 'header_footer'
                        WHEN {_ALNUM} < {C.MIN_ALNUM} THEN 'too_short' WHEN {_GIBBERISH} THEN 'gibberish' END AS reason
            FROM tl t LEFT JOIN tp ON tp.source_document = t.source_document AND tp.template = t.template),
        dr AS (
            SELECT *, CASE WHEN reason IS NULL AND lag(norm) OVER (PARTITION BY source_document, page, reason IS NULL ORDER BY line_no) = norm THEN 'duplicate' ELSE reason END AS drop_reason FROM rs)"""
_CAPS = r"regexp_matches(line, '^[A-Z][A-Z\s\-–—/&(),.'']{5,}$') AND length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 6 AND length(replace(line, '(', '')) = length(replace(line, ')', '')) AND NOT regexp_matches(line, '(?i)^NO\.?\s') AND NOT regexp_matches(line, '[/\-–—,]\s*$')"
_FITS = f"length(line) BETWEEN 3 AND {C.HEADING_LENGTH}"

ORACLE_SQL = {
    "line_explode": f"WITH {_LINES} SELECT source_document, page, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM li GROUP BY ALL",
    "short_lines": f"WITH {_LINES} SELECT source_document, page, line_no, line, {_ALNUM} AS n_alnum FROM li WHERE {_ALNUM} < {C.MIN_ALNUM}",
    "page_number_lines": f"WITH {_LINES}, {_fx(NUMBERED)} SELECT source_document, page, line_no, form, {_PAGE_NUMBER} AS is_page_number FROM fx",
    "glyph_lines": rf"WITH {_LINES}, {_fx(NUMBERED)} SELECT source_document, page, line_no, form, regexp_matches(line, '\(cid:\d+\)') AS is_glyph FROM fx",
    "gibberish_lines": f"WITH {_LINES} SELECT source_document, page, line_no, line FROM li WHERE {_GIBBERISH}",
    "header_footer_templates": f"WITH {_LINES}, {_TEMPLATES} SELECT source_document, template, n FROM tp",
    "line_filter_report": f"WITH {_LINES}, {_REASONS} SELECT source_document, coalesce(drop_reason, 'kept') AS reason, count(*) AS n_lines FROM dr GROUP BY ALL",
    "noisy_pages": f"WITH {_LINES}, {_REASONS} SELECT source_document, page, count(*) AS n_lines, count(drop_reason) AS n_dropped FROM dr GROUP BY ALL HAVING count(*) >= {C.NOISY_LINES} AND count(drop_reason) >= {C.NOISY_SHARE} * count(*)",
    "clean_pages": f"WITH {_LINES}, {_REASONS} SELECT source_document, page, length(string_agg(norm, chr(10) ORDER BY line_no)) AS n_chars, md5(string_agg(norm, chr(10) ORDER BY line_no)) AS digest FROM dr WHERE drop_reason IS NULL GROUP BY ALL",
    "short_line_limit": f"WITH {_LINES} SELECT source_document, round(coalesce(median(CASE WHEN length(line) > {C.SHORT_LINE_OVER} THEN length(line) END) * 6e-1, 40e0), 6) AS short_limit FROM li GROUP BY ALL",
    "paragraph_blocks": rf"""WITH {_LINES},
        sl AS (SELECT source_document, coalesce(median(CASE WHEN length(line) > {C.SHORT_LINE_OVER} THEN length(line) END) * 6e-1, 40e0) AS lim FROM li GROUP BY ALL),
        pv AS (SELECT li.*, lim, lag(line) OVER (PARTITION BY li.source_document ORDER BY page, line_no) AS prev FROM li JOIN sl USING (source_document)),
        nb AS (SELECT *, prev IS NULL OR regexp_matches(line, '^(?:[-•*▪o]\s+|\(?\d{{1,2}}[.)]\s+|[a-z][.)]\s+)') OR regexp_matches(prev, '[.!?:;]\s*$') OR length(prev) < lim AS new_block FROM pv),
        bl AS (SELECT *, sum(CAST(new_block AS BIGINT)) OVER (PARTITION BY source_document ORDER BY page, line_no) AS block_no FROM nb)
        SELECT source_document, CAST(block_no AS BIGINT) AS block_no, count(*) AS n_lines, min(page) AS page_start, max(page) AS page_end, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM bl GROUP BY ALL""",
    "chunk_noise": f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS ws FROM documents)
        SELECT doc_id, len(ws) = 0 OR (len(list_filter(ws, lambda x: x IN {C.STOPWORDS})) <= {C.NOISE_STOPWORDS} * len(ws) AND length(regexp_replace(text, '[^0-9]', '', 'g')) < {C.NOISE_DIGITS} * length(text) AND NOT regexp_matches(text, '[.:;?!]')) AS is_noise FROM w""",
    "page_ranges": f"""WITH {_LINES}, p AS (SELECT DISTINCT source_document, page FROM li WHERE len(string_split(line, ' ')) <= 6),
        g AS (SELECT *, page - row_number() OVER (PARTITION BY source_document ORDER BY page) AS g FROM p),
        i AS (SELECT source_document, min(page) AS a, max(page) AS z FROM g GROUP BY source_document, g)
        SELECT source_document, string_agg(CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || '–' || z END, ', ' ORDER BY a) AS page_ranges FROM i GROUP BY ALL""",
}


_LEVEL = rf"""CASE WHEN NOT ({_FITS}) THEN NULL WHEN regexp_matches(line, '^(?:BAB|Bab|BAGIAN|Bagian)\s+[IVXLCDM\d]+\b') OR regexp_matches(line, '^(?:LAMPIRAN|Lampiran)\b') THEN 0
             WHEN regexp_matches(line, '^(?:PASAL|Pasal)\s+\d+\b') THEN 1 WHEN regexp_matches(line, '^\d+\.\d+(?:\.\d+)?\s+\S') OR regexp_matches(line, '^[A-Z]\.\s+[A-Z]') THEN 2 WHEN {_CAPS} THEN 0 END"""
_STRUCTURAL = rf"(regexp_matches(line, '^(?:BAB|Bab|BAGIAN|Bagian)\s+[IVXLCDM\d]+\b') OR regexp_matches(line, '^(?:LAMPIRAN|Lampiran)\b'))"
_BULLET = r"'^(?:[-•*▪o]\s+|\(?\d{1,2}[.)]\s+|[a-z][.)]\s+)'"
_CONTINUES = "(f.title AND NOT h.structural AND len(f.path) > 0 AND h.caps)"


def _joined(partition: str) -> str:
    """Pieces of re-joined lines: a hyphen before a lower-case start glues.  Needs ``line`` and ``i``."""
    nxt, prv = (f"{f}(line) OVER (PARTITION BY {partition} ORDER BY i)" for f in ("lead", "lag"))
    glues = lambda a, b: f"coalesce({a} LIKE '%-' AND lower(left({b}, 1)) = left({b}, 1) AND upper(left({b}, 1)) <> left({b}, 1), false)"
    return f"CASE WHEN {prv} IS NULL OR {glues(prv, 'line')} THEN '' ELSE ' ' END || CASE WHEN {glues('line', nxt)} THEN left(line, length(line) - 1) ELSE line END"


# The folds as recursive queries: one step a line for blocks, one a block for chunks, one a unit for the parts of long blocks.
_CHUNKS = rf"""{_LINES},
        lm AS (SELECT source_document AS src, coalesce(median(CASE WHEN length(line) > {C.SHORT_LINE_OVER} THEN length(line) END) * 6e-1, 40e0) AS lim FROM li GROUP BY ALL),
        hl AS (
            SELECT src, page, line, lim, {_LEVEL} AS level, {_STRUCTURAL} AS structural, regexp_matches(line, '^[A-Z][A-Z\s\-–—/&(),.'']{{5,}}$') AS caps,
                   row_number() OVER (PARTITION BY src ORDER BY page, line_no) AS i, dense_rank() OVER (PARTITION BY src ORDER BY page) AS pr
            FROM li JOIN lm ON src = source_document),
        fb AS (
            SELECT src, i, CAST(1 AS BIGINT) AS b, CASE WHEN level IS NULL THEN []::VARCHAR[] ELSE [line] END AS path, CASE WHEN level IS NULL THEN line END AS last, level IS NOT NULL AND structural AS title FROM hl WHERE i = 1
            UNION ALL
            SELECT h.src, h.i, f.b + CASE WHEN h.level IS NULL THEN CAST(f.last IS NULL OR regexp_matches(h.line, {_BULLET}) OR regexp_matches(f.last, '[.!?:;]\s*$') OR length(f.last) < h.lim AS BIGINT) WHEN {_CONTINUES} THEN 0 ELSE 1 END,
                   CASE WHEN h.level IS NULL THEN f.path WHEN {_CONTINUES} THEN list_concat(f.path[1:len(f.path) - 1], [f.path[len(f.path)] || ' ' || h.line]) ELSE list_concat(f.path[1:h.level], [h.line]) END,
                   CASE WHEN h.level IS NULL THEN h.line END, h.level IS NOT NULL AND NOT {_CONTINUES} AND h.structural
            FROM fb f JOIN hl h ON h.src = f.src AND h.i = f.i + 1),
        bli AS (SELECT fb.src, fb.i, b, path, line, page, pr FROM fb JOIN hl ON hl.src = fb.src AND hl.i = fb.i),
        blk AS (
            SELECT src, b, string_agg(piece, '' ORDER BY i) AS txt, arg_max(path, i) AS path, min(pr) AS p1, max(pr) AS p2 FROM (SELECT *, {_joined("src, b")} AS piece FROM bli) GROUP BY src, b),
        bs AS (SELECT *, length(txt) AS n, sum(length(txt)) OVER (PARTITION BY src ORDER BY b) - length(txt) AS s0, lag(p2) OVER (PARTITION BY src ORDER BY b) AS p2_before FROM blk),
        bx AS (
            SELECT x.*, coalesce((SELECT min(c.b) FROM bs c WHERE c.src = x.src AND c.b <= x.b AND x.s0 - c.s0 <= {C.CHUNK_OVERLAP}), x.b) AS c0,
                   coalesce((SELECT min(c.b) FROM bs c WHERE c.src = x.src AND c.b < x.b AND c.p1 >= x.p2_before - {C.MAX_PAGES - 2}), x.b) AS c1 FROM bs x),
        pk AS (
            SELECT src, CAST(0 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS ea FROM bx GROUP BY src
            UNION ALL
            SELECT p.src, x.b,
                   CASE WHEN x.n > {C.CHUNK_SIZE} THEN NULL WHEN p.a IS NULL THEN x.b WHEN x.s0 - y.s0 + x.n > {C.CHUNK_SIZE} OR x.p2 - y.p1 + 1 > {C.MAX_PAGES} THEN greatest(p.a + 1, x.c0, x.c1)
                        WHEN x.path <> y.path AND x.s0 - y.s0 >= {C.SMALL_MERGE} * {C.CHUNK_SIZE} THEN x.b ELSE p.a END,
                   CASE WHEN p.a IS NOT NULL AND (x.n > {C.CHUNK_SIZE} OR x.s0 - y.s0 + x.n > {C.CHUNK_SIZE} OR x.p2 - y.p1 + 1 > {C.MAX_PAGES} OR (x.path <> y.path AND x.s0 - y.s0 >= {C.SMALL_MERGE} * {C.CHUNK_SIZE})) THEN p.a END
            FROM pk p JOIN bx x ON x.src = p.src AND x.b = p.b + 1 LEFT JOIN bx y ON y.src = p.src AND y.b = p.a),
        em AS (
            SELECT src, b AS step, ea AS first_b, b - 1 AS last_b FROM pk WHERE ea IS NOT NULL
            UNION ALL SELECT src, b + 1, a, b FROM pk WHERE a IS NOT NULL AND (src, b) IN (SELECT src, max(b) FROM bx GROUP BY src)),
        un AS (
            SELECT src, b, i, page, path, unnest(CASE WHEN length(line) + 1 > {C.CHUNK_SIZE} THEN string_split(regexp_replace(line, '([.!?;]){_SPACE}+', '\1' || chr(1), 'g'), chr(1)) ELSE [line] END) AS line, length(line) + 1 > {C.CHUNK_SIZE} AS cut,
                   unnest(range(1, 1 + CASE WHEN length(line) + 1 > {C.CHUNK_SIZE} THEN len(string_split(regexp_replace(line, '([.!?;]){_SPACE}+', '\1' || chr(1), 'g'), chr(1))) ELSE 1 END)) AS k
            FROM (SELECT bli.src, bli.b, bli.i, bli.page, bx.path, bli.line FROM bli JOIN bx ON bx.src = bli.src AND bx.b = bli.b AND bx.n > {C.CHUNK_SIZE})),
        uj AS (SELECT *, row_number() OVER (PARTITION BY src, b ORDER BY i, k) AS j FROM un),
        sp AS (
            SELECT src, b, j, CAST(1 AS BIGINT) AS g, length(line) + CASE WHEN cut THEN 0 ELSE 1 END AS held, cut FROM uj WHERE j = 1
            UNION ALL
            SELECT u.src, u.b, u.j, s.g + CASE WHEN u.cut <> s.cut OR (u.cut AND u.k = 1) OR s.held + length(u.line) + 1 > {C.CHUNK_SIZE} THEN 1 ELSE 0 END,
                   CASE WHEN u.cut <> s.cut OR (u.cut AND u.k = 1) OR s.held + length(u.line) + 1 > {C.CHUNK_SIZE} THEN length(u.line) + CASE WHEN u.cut THEN 0 ELSE 1 END ELSE s.held + length(u.line) + 1 END, u.cut
            FROM sp s JOIN uj u ON u.src = s.src AND u.b = s.b AND u.j = s.j + 1),
        ug AS (SELECT uj.src, uj.b, g, uj.j AS i, uj.line, uj.page, uj.path, uj.cut FROM sp JOIN uj ON uj.src = sp.src AND uj.b = sp.b AND uj.j = sp.j),
        up AS (SELECT *, {_joined("src, b, g")} AS piece FROM ug),
        pt AS (
            SELECT src, b, g, any_value(path) AS path, CASE WHEN bool_or(cut) THEN string_agg(line, ' ' ORDER BY i) ELSE string_agg(piece, '' ORDER BY i) END AS txt, list_sort(list(DISTINCT page)) AS pages FROM up GROUP BY src, b, g),
        raw_chunk AS (
            SELECT em.src, step, CAST(0 AS BIGINT) AS part, any_value(CASE WHEN bx.b = first_b THEN bx.path END) AS path, string_agg(bx.txt, chr(10) || chr(10) ORDER BY bx.b) AS txt,
                   (SELECT list_sort(list(DISTINCT page)) FROM bli WHERE bli.src = em.src AND bli.b BETWEEN first_b AND last_b) AS pages
            FROM em JOIN bx ON bx.src = em.src AND bx.b BETWEEN first_b AND last_b GROUP BY em.src, step, first_b, last_b
            UNION ALL SELECT src, b, g, path, txt, pages FROM pt),
        ch AS (
            SELECT row_number() OVER (ORDER BY src, step, part) - 1 AS chunk_index, src AS source_document, path, txt AS text, pages, length(txt) AS char_count, CASE WHEN len(path) > 0 THEN path[len(path)] ELSE '' END AS section_title
            FROM raw_chunk WHERE length(txt) >= {C.MIN_CHUNK} AND NOT {{noise}})"""
_NOISE_OF = f"""(len(regexp_extract_all(lower(txt), '[a-z]+')) = 0 OR (len(list_filter(regexp_extract_all(lower(txt), '[a-z]+'), lambda x: x IN {C.STOPWORDS})) <= {C.NOISE_STOPWORDS} * len(regexp_extract_all(lower(txt), '[a-z]+'))
            AND length(regexp_replace(txt, '[^0-9]', '', 'g')) < {C.NOISE_DIGITS} * length(txt) AND NOT regexp_matches(txt, '[.:;?!]')))"""
_CHUNKS = _CHUNKS.replace("{noise}", _NOISE_OF)
_PREPARED = f"WITH RECURSIVE {_LINES}, {_REASONS}, lk AS (SELECT source_document, page, line_no, norm AS line FROM dr WHERE drop_reason IS NULL)" + _CHUNKS.removeprefix(_LINES).replace("FROM li ", "FROM lk ")
_CHUNKS = "WITH RECURSIVE " + _CHUNKS
_LABEL = "CASE WHEN len(pages) = 0 THEN '-' WHEN list_min(pages) = list_max(pages) THEN CAST(list_min(pages) AS VARCHAR) ELSE list_min(pages) || '-' || list_max(pages) END"
_PATH = "CASE WHEN len(path) > 0 THEN array_to_string(path, ' > ') || {} || text ELSE text END"


ORACLE_SQL |= {
    "chunk_documents": f"""{_CHUNKS} SELECT chunk_index, source_document, {_LABEL} AS page_label, list_min(pages) AS page_start, list_max(pages) AS page_end, char_count, char_count // 4 AS estimated_tokens, array_to_string(pages, ',') AS pages, section_title,
        array_to_string(path, ' › ') AS heading_path_label, regexp_replace(source_document, '\\.[^.]*$', '') AS document_label, md5(text) AS digest, md5({_PATH.format("chr(10) || chr(10)")}) AS embed_digest, md5({_PATH.format("chr(10)")}) AS index_digest FROM ch""",
    "chunk_stats": f"""{_CHUNKS} SELECT count(*) AS n_chunks, min(char_count) AS min_chars, max(char_count) AS max_chars, CAST(sum(char_count) // count(*) AS BIGINT) AS avg_chars, min(char_count // 4) AS min_tokens, max(char_count // 4) AS max_tokens,
        CAST(sum(char_count // 4) // count(*) AS BIGINT) AS avg_tokens, max(len(pages)) AS max_pages, round(avg(len(pages)), 2) AS avg_pages, count(*) FILTER (len(pages) = 1) AS one_page, count(*) FILTER (len(path) > 0) AS with_heading FROM ch""",
    "corpus_summary": f"""{_CHUNKS}, pp AS (SELECT unnest(pages) AS p FROM ch)
        SELECT count(*) AS n_chunks, count(DISTINCT source_document) AS n_documents, max(len(pages)) AS max_span, round(avg(len(pages)), 2) AS avg_span, (SELECT count(DISTINCT p) FROM pp) AS distinct_page_numbers, (SELECT min(p) FROM pp) AS page_min, (SELECT max(p) FROM pp) AS page_max FROM ch""",
    "build_stats": f"{_CHUNKS}, pp AS (SELECT source_document, chunk_index, unnest(pages) AS p FROM ch) SELECT source_document, count(DISTINCT chunk_index) AS n_chunks, count(DISTINCT p) AS document_pages FROM pp GROUP BY ALL",
    "source_documents": f"{_CHUNKS} SELECT DISTINCT source_document FROM ch WHERE trim(source_document) <> ''",
    "chunk_sections": f"{_CHUNKS} SELECT DISTINCT section_title FROM ch WHERE section_title <> ''",
    "prepared_chunks": f"{_PREPARED} SELECT chunk_index, source_document, {_LABEL} AS page_label, char_count, md5(text) AS digest FROM ch",
    "document_records": f"""{_PREPARED},
        n AS (SELECT source_document, count(*) AS chunks FROM ch GROUP BY ALL),
        l AS (SELECT source_document, count(*) AS lines_raw, count(*) FILTER (drop_reason IS NULL) AS lines_kept, count(DISTINCT page) AS pages_raw, count(DISTINCT page) FILTER (drop_reason IS NULL) AS pages_with_text FROM dr GROUP BY ALL),
        x AS (SELECT source_document, string_agg(e, ',' ORDER BY e) AS dropped FROM (SELECT source_document, drop_reason || ':' || count(*) AS e FROM dr WHERE drop_reason IS NOT NULL GROUP BY source_document, drop_reason) GROUP BY ALL)
        SELECT source_document AS name, sha256(source_document) AS sha256, length(source_document) AS size_bytes, pages_with_text, chunks, lines_raw, lines_kept, coalesce(dropped, '') AS dropped, pages_raw - pages_with_text AS pages_empty_after_cleaning
        FROM n JOIN l USING (source_document) LEFT JOIN x USING (source_document)""",
    "index_record": f"""{_PREPARED}, pp AS (SELECT DISTINCT source_document, unnest(pages) AS p FROM ch)
        SELECT {C.PIPELINE_VERSION} AS pipeline_version, count(DISTINCT source_document) AS n_listed, count(DISTINCT source_document) AS total_documents, (SELECT count(*) FROM pp) AS total_pages, count(*) AS total_chunks, count(*) FILTER (len(pages) = 1) AS single_page_chunks, max(len(pages)) AS max_pages_per_chunk,
               CAST(sum(char_count) // count(*) AS BIGINT) AS avg_chars, {C.CHUNK_SIZE} AS chunk_size, {C.CHUNK_OVERLAP} AS chunk_overlap FROM ch""",
    "drop_reasons": f"WITH {_LINES}, {_REASONS} SELECT drop_reason AS reason, count(*) AS n_lines FROM dr WHERE drop_reason IS NOT NULL GROUP BY ALL ORDER BY n_lines DESC, reason",
    "noisiest_pages": f"WITH {_LINES}, {_REASONS} SELECT source_document, page, count(*) AS n_lines, count(drop_reason) AS n_dropped FROM dr GROUP BY ALL HAVING count(*) >= {C.NOISY_LINES} AND count(drop_reason) >= {C.NOISY_SHARE} * count(*) ORDER BY n_dropped DESC, source_document, page LIMIT 6",
    "table_lines": """SELECT CAST(s_nationkey AS BIGINT) AS nation, coalesce(string_agg(trim(s_name) || ' | ' || CASE WHEN s_acctbal > 5000 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END, chr(10) ORDER BY s_suppkey) FILTER (s_acctbal >= 0), '') AS text FROM supplier GROUP BY ALL""",
    "explorer_search": f"{_CHUNKS} SELECT chunk_index, source_document, {_LABEL} AS page_label FROM ch WHERE contains(lower(text || ' ' || section_title), 'a.') ORDER BY chunk_index LIMIT 50",
    "document_page_numbers": f"WITH {_LINES} SELECT source_document, page, line_no, line FROM li WHERE {_PAGE_NUMBER}",
    "document_glyph_lines": rf"WITH {_LINES} SELECT source_document, page, line_no, line FROM li WHERE regexp_matches(line, '\(cid:\d+\)')",
    "heading_detection": f"WITH {_LINES}, {_fx(HEADED)} SELECT source_document, page, line_no, form, CAST({_LEVEL} AS BIGINT) AS level, CASE WHEN ({_LEVEL}) IS NOT NULL THEN {_STRUCTURAL} END AS structural FROM fx",
    "document_headings": f"WITH {_LINES} SELECT * FROM (SELECT source_document, page, line_no, line, CAST({_LEVEL} AS BIGINT) AS level, {_STRUCTURAL} AS structural FROM li) WHERE level IS NOT NULL",
}
