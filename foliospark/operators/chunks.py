"""Paragraph blocks and page-accurate chunks.

Headings, paragraph starts and statistics are column expressions.  The heading
stack and the packing of blocks are ordered folds over one document.  They are
generators over a document's lines: sorted lines stream through an Arrow map that
holds one chunk's blocks at a time, so a document of any length needs constant
memory.
"""

from __future__ import annotations

import re
import statistics
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..storage import written

# Heading patterns as (level, structural, pattern), tried in order.
HEADINGS = (
    (0, True, r"^(?:BAB|Bab|BAGIAN|Bagian)\s+[IVXLCDM\d]+\b"),
    (0, True, r"^(?:LAMPIRAN|Lampiran)\b"),
    (1, False, r"^(?:PASAL|Pasal)\s+\d+\b"),
    (2, False, r"^\d+\.\d+(?:\.\d+)?\s+\S"),
    (2, False, r"^[A-Z]\.\s+[A-Z]"),
)
# All-caps lines, table headers, cut titles, bullets and sentence ends.
ALL_CAPS = r"^[A-Z][A-Z\s\-–—/&(),.']{5,}$"
TABLE_HEAD = r"(?i)^NO\.?\s"
CUT_TITLE = r"[/\-–—,]\s*$"
BULLET = r"^(?:[-•*▪o]\s+|\(?\d{1,2}[.)]\s+|[a-z][.)]\s+)"
SENTENCE_END = r"[.!?:;]\s*$"


def all_caps_heading(line: Column) -> Column:
    letters = F.length(F.regexp_replace(line, "[^\\p{L}]", ""))
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return line.rlike(ALL_CAPS) & (letters >= C.CAPS_LETTERS) & (count("(") == count(")")) & ~line.rlike(TABLE_HEAD) & ~line.rlike(CUT_TITLE)


def heading(line: Column) -> tuple[Column, Column]:
    """Level and structural mark of a heading line; null for other lines."""
    fits = (F.length(line) >= 3) & (F.length(line) <= C.HEADING_LENGTH)
    level = structural = None
    for lv, st, pattern in HEADINGS:
        hit = fits & line.rlike(pattern)
        level = F.when(hit, lv) if level is None else level.when(hit, lv)
        structural = F.when(hit, st) if structural is None else structural.when(hit, st)
    caps = fits & all_caps_heading(line)
    return level.when(caps, 0), structural.when(caps, False)


def short_line_limit(lines: DataFrame) -> DataFrame:
    """By document: 0.6 of the exact median of lengths over 20; 40.0 without such lines."""
    long = F.when(F.length("line") > C.SHORT_LINE_OVER, F.length("line"))
    return lines.groupBy("source_document").agg(F.coalesce(F.median(long) * C.SHORT_LINE_SHARE, F.lit(C.SHORT_LINE_DEFAULT)).alias("short_limit"))


def paragraph_starts(lines: DataFrame) -> DataFrame:
    """``lines`` with ``new_block`` and a running ``block_no``, where no heading intervenes."""
    order = Window.partitionBy("source_document").orderBy("page", "line_no")
    before = F.lag("line").over(order)
    limit = short_line_limit(lines)
    df = lines.join(limit, "source_document")
    new = before.isNull() | F.col("line").rlike(BULLET) | before.rlike(SENTENCE_END) | (F.length(before) < F.col("short_limit"))
    df = df.withColumn("new_block", F.coalesce(new, F.lit(True)))
    return df.withColumn("block_no", F.sum(F.col("new_block").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def looks_like_noise(text: Column) -> Column:
    """No words; or hardly a function word, few digits and no closing mark."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    known = F.array(*[F.lit(w) for w in C.STOPWORDS])
    stop = F.size(F.filter(words, lambda w: F.array_contains(known, w)))
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return (F.size(words) == 0) | ((stop <= C.NOISE_STOPWORDS * F.size(words)) & (digits < C.NOISE_DIGITS * F.length(text)) & ~text.rlike("[.:;?!]"))


# ---- The folds over one document -------------------------------------------

_HEADING_RE = [(lv, st, re.compile(p)) for lv, st, p in HEADINGS]
_CAPS_RE, _HEAD_RE, _CUT_RE, _BULLET_RE, _END_RE = (re.compile(p) for p in (ALL_CAPS, TABLE_HEAD, CUT_TITLE, BULLET, SENTENCE_END))
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")


@dataclass
class Block:
    lines: list[tuple[int, str]]
    path: tuple[str, ...] = ()
    _text: str | None = field(default=None, repr=False)

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = join_lines([t for _, t in self.lines])
        return self._text

    @property
    def pages(self) -> set[int]:
        return {p for p, _ in self.lines}


def join_lines(lines: list[str]) -> str:
    """Wrapped lines as running text; a hyphen before a lower-case start glues."""
    out = ""
    for line in filter(None, (x.strip() for x in lines)):
        if out.endswith("-") and line[0].islower():
            out = out[:-1] + line
        else:
            out = f"{out} {line}" if out else line
    return out


def heading_of(line: str) -> tuple[int, bool] | None:
    """(level, structural) of a stripped line."""
    if not 3 <= len(line) <= C.HEADING_LENGTH:
        return None
    for level, structural, pattern in _HEADING_RE:
        if pattern.match(line):
            return level, structural
    caps = _CAPS_RE.match(line) and sum(map(str.isalpha, line)) >= C.CAPS_LETTERS and line.count("(") == line.count(")")
    return (0, False) if caps and not _HEAD_RE.match(line) and not _CUT_RE.search(line) else None


def stream_blocks(lines: Iterable[tuple[int, str]], limit: float) -> Iterator[Block]:
    """Paragraphs and headings in order, each with the heading path above it.

    A block leaves when the next one begins: until then a structural heading may
    still take its title from the following line.
    """
    path: tuple[str, ...] = ()
    held: Block | None = None  # the block that has not left yet
    paragraph = title = False  # whether it takes further lines, or a title
    for page, line in lines:
        found = heading_of(line)
        if found is None:
            last = held.lines[-1][1] if paragraph else None
            if last is None or _BULLET_RE.match(line) or _END_RE.search(last) or len(last) < limit:
                if held:
                    yield held
                held, paragraph, title = Block([], path), True, False
            held.lines.append((page, line))
        elif title and not found[1] and path and _CAPS_RE.match(line):
            path = (*path[:-1], f"{path[-1]} {line}")
            held.lines.append((page, line))
            held.path, title = path, False
        else:
            if held:
                yield held
            path = (*path[: found[0]], line)
            held, paragraph, title = Block([(page, line)], path), False, found[1]
    if held:
        yield held


def blocks_of(lines: list[tuple[int, str]]) -> list[Block]:
    """All blocks of a document at hand, with its own limit for short lines."""
    long = [len(t) for _, t in lines if len(t) > C.SHORT_LINE_OVER]
    return list(stream_blocks(lines, statistics.median(long) * C.SHORT_LINE_SHARE if long else C.SHORT_LINE_DEFAULT))


def split_line(line: tuple[int, str], size: int) -> list[tuple[int, str]]:
    """A long line in parts of whole sentences."""
    parts = [""]
    for sentence in _SENTENCE.split(line[1]):
        if parts[-1] and len(parts[-1]) + 1 + len(sentence) > size:
            parts.append(sentence)
        else:
            parts[-1] = f"{parts[-1]} {sentence}".strip()
    return [(line[0], p.strip()) for p in parts if p.strip()] or [line]


def split_block(block: Block, size: int) -> list[Block]:
    """A block over ``size`` in parts at line bounds; lines over it by sentence."""
    groups: list[list[tuple[int, str]]] = [[]]
    held = 0
    for line in block.lines:
        n = len(line[1]) + 1
        if n > size:
            groups += [[part] for part in split_line(line, size)] + [[]]
            held = 0
            continue
        if held and held + n > size:
            groups.append([])
            held = 0
        groups[-1].append(line)
        held += n
    return [Block(g, block.path) for g in groups if g]


def _span(blocks: list[Block]) -> int:
    return len(set().union(*(b.pages for b in blocks)))


def carried(blocks: list[Block], overlap: int, max_pages: int) -> list[Block]:
    """Whole blocks at the end of a chunk, never its first, that begin the next one."""
    out: list[Block] = []
    room = overlap
    for b in reversed(blocks[1:]):
        room -= len(b.text)
        if overlap <= 0 or room < 0:
            break
        out.insert(0, b)
    while out and _span(out) >= max_pages:
        del out[0]
    return out


def _chunk(blocks: list[Block]) -> Iterator[dict]:
    text = "\n\n".join(b.text for b in blocks if b.text.strip()).strip()
    if text:
        yield {"text": text, "pages": sorted(set().union(*(b.pages for b in blocks))), "path": list(blocks[0].path)}


def stream_chunks(blocks: Iterable[Block], size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, max_pages: int = C.MAX_PAGES, strict_page_cap: bool = False) -> Iterator[dict]:
    """Chunks in order.  Size and page caps are soft: carried blocks count, joiners do not."""
    now: list[Block] = []
    for block in blocks:
        n = len(block.text)
        if n > size:
            yield from _chunk(now)
            for part in split_block(block, size):
                yield from _chunk([part])
            now = []
            continue
        if now:
            held = sum(len(b.text) for b in now)
            if held + n > size or _span([*now, block]) > max_pages:
                yield from _chunk(now)
                now = carried(now, overlap, max_pages)
                while strict_page_cap and now and _span([*now, block]) > max_pages:
                    del now[0]
            elif block.path != now[0].path and held >= C.SMALL_MERGE * size:
                yield from _chunk(now)
                now = []
        now = [*now, block]
    yield from _chunk(now)


def pack(blocks: list[Block], size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, max_pages: int = C.MAX_PAGES, strict_page_cap: bool = False) -> list[dict]:
    """All chunks of the blocks at hand."""
    return list(stream_chunks(blocks, size, overlap, max_pages, strict_page_cap))


CHUNK = "source_document string, local_no long, text string, page_numbers array<long>, section_title string, heading_path array<string>"
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.string())]
_NAMES = ["source_document", "local_no", "text", "page_numbers", "section_title", "heading_path"]
OUT_ROWS = 500


def _fold(size: int, overlap: int, max_pages: int, strict: bool):
    """Lines sorted by document, page and line in, each document's limit before them; chunks out, a few at a time."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], _NAMES)

    def run(batches):
        lines = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(4))))
        rows: list[tuple] = []
        for source, document in groupby(lines, key=itemgetter(0)):
            limit = next(document)[3]
            numbered = ((page, line) for _, page, line, _ in document)
            for i, c in enumerate(stream_chunks(stream_blocks(numbered, limit), size, overlap, max_pages, strict)):
                rows.append((source, i, c["text"], c["pages"], c["path"][-1] if c["path"] else "", c["path"]))
                if len(rows) == OUT_ROWS:
                    yield batch(rows)
                    rows = []
        yield batch(rows)

    return run


def offsets(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``(key, before)``: the sum of ``n`` over all smaller keys, without a window over all rows.

    Keys are dealt out in ranges; the driver adds up one sum a range, and a
    window runs inside each.
    """
    dealt = written(counts.select(key, n).repartitionByRange(key).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = {r["__range"]: r["s"] for r in dealt.groupBy("__range").agg(F.sum(n).alias("s")).collect()}
    total, starts = 0, []
    for part in range(max(sums, default=-1) + 1):
        starts.append(total)
        total += sums.get(part, 0)
    base = F.element_at(F.split(F.lit(",".join(map(str, starts)) or "0"), ",").cast("array<long>"), F.col("__range") + 1)
    inside = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(key, (base + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias("before"))


def chunk_lines(lines: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, min_size: int = C.MIN_CHUNK, max_pages: int = C.MAX_PAGES, drop_noise: bool = True, strict_page_cap: bool = False) -> DataFrame:
    """Chunks of ``lines``, filtered and numbered from 0 in document order.

    A document is the unit of citation and is folded by one task, whose memory
    does not grow with it.  Numbers come from counts by document and prefix sums.

    A document's limit is a row that sorts before its lines.  They are dealt by a
    hash of the document, not by its column: Spark leaves out a repartition by a
    column that a join or window below has dealt by, and may then read that
    join's shuffle locally, which tears documents apart.
    """
    limits = short_line_limit(lines).select("source_document", F.lit(None).cast("long").alias("page"), F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("line"), "short_limit")
    rows = lines.select("source_document", F.col("page").cast("long").alias("page"), F.col("line_no").cast("long").alias("line_no"), "line", F.lit(None).cast("double").alias("short_limit")).unionByName(limits)
    dealt = rows.filter("source_document is not null").repartition(F.xxhash64("source_document")).sortWithinPartitions("source_document", F.asc_nulls_first("page"), "line_no").select("source_document", "page", "line", "short_limit")
    kept = dealt.mapInArrow(_fold(size, overlap, max_pages, strict_page_cap), CHUNK).filter(F.length("text") >= min_size)
    if drop_noise:
        kept = kept.filter(~looks_like_noise(F.col("text")))
    kept = written(kept, "chunks")
    local = F.row_number().over(Window.partitionBy("source_document").orderBy("local_no")) - 1
    before = offsets(kept.groupBy("source_document").agg(F.count("*").alias("n")), "source_document")
    return kept.withColumn("local_no", local.cast("long")).join(before, "source_document").select((F.col("before") + F.col("local_no")).alias("chunk_index"), "source_document", "text", "page_numbers", "section_title", "heading_path")


def with_labels(chunks: DataFrame) -> DataFrame:
    """Derived fields of a chunk: sizes, page range and label, embedding and index texts."""
    lo, hi = F.array_min("page_numbers"), F.array_max("page_numbers")
    label = F.when(F.size("page_numbers") == 0, "-").when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string")))
    path = F.array_join("heading_path", " > ")
    return chunks.select(
        "*", F.length("text").cast("long").alias("char_count"), F.floor(F.length("text") / 4).cast("long").alias("estimated_tokens"), lo.alias("page_start"), hi.alias("page_end"), label.alias("page_label"),
        F.when(F.size("heading_path") > 0, F.concat(path, F.lit("\n\n"), "text")).otherwise(F.col("text")).alias("embed_text"),
        F.when(F.size("heading_path") > 0, F.concat(path, F.lit("\n"), "text")).when(F.col("section_title") != "", F.concat("section_title", F.lit("\n"), "text")).otherwise(F.col("text")).alias("index_text"),
        F.array_join("heading_path", " › ").alias("heading_path_label"), F.regexp_replace("source_document", r"\.[^.]*$", "").alias("document_label"),
    )


def corpus_summary(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct page numbers over all documents, range, spans, sections."""
    pages = chunks.select(F.explode("page_numbers").alias("p")).agg(F.countDistinct("p").alias("distinct_page_numbers"), F.min("p").alias("page_min"), F.max("p").alias("page_max"))
    spans = chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("source_document").alias("n_documents"), F.max(F.size("page_numbers")).cast("long").alias("max_span"), F.round(F.avg(F.size("page_numbers").cast("double")), 2).alias("avg_span"))
    return spans.crossJoin(F.broadcast(pages))


def document_pages(chunks: DataFrame) -> DataFrame:
    """By document: chunks and distinct pages; their sum differs from the pooled count."""
    return chunks.select("source_document", "chunk_index", F.explode("page_numbers").alias("p")).groupBy("source_document").agg(F.countDistinct("chunk_index").alias("n_chunks"), F.countDistinct("p").alias("document_pages"))


def source_documents(chunks: DataFrame) -> DataFrame:
    """The distinct documents by name, blanks left out."""
    return chunks.select("source_document").filter(F.trim("source_document") != "").distinct().orderBy("source_document")


def sections(chunks: DataFrame) -> DataFrame:
    """The distinct section titles by name, blanks left out."""
    return chunks.select("section_title").filter(F.col("section_title") != "").distinct().orderBy("section_title")


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """One row: sizes with whole averages, spans, and chunks of one page and under a heading.  ``chunks`` are labelled."""
    span = F.size("page_numbers")
    whole = lambda c: F.floor(F.sum(c) / F.count("*")).cast("long")
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.min("char_count").alias("min_chars"), F.max("char_count").alias("max_chars"), whole("char_count").alias("avg_chars"), F.min("estimated_tokens").alias("min_tokens"), F.max("estimated_tokens").alias("max_tokens"),
        whole("estimated_tokens").alias("avg_tokens"), F.max(span).cast("long").alias("max_pages"), F.round(F.avg(span.cast("double")), 2).alias("avg_pages"), F.count_if(span == 1).alias("one_page"), F.count_if(F.size("heading_path") > 0).alias("with_heading"),
    )


def explore(chunks: DataFrame, term: str | None = None, limit: int = 50) -> DataFrame:
    """The first chunks by number whose text or section holds ``term``, taken literally and in any case."""
    held = F.lower(F.concat_ws(" ", "text", F.coalesce("section_title", F.lit(""))))
    found = chunks.filter(F.contains(held, F.lit(term.lower()))) if term else chunks
    return found.orderBy("chunk_index").limit(limit)


def page_ranges(df: DataFrame, key: str, pages: str) -> DataFrame:
    """``(key, label)`` such as ``39–40, 48``; ``-`` without pages."""
    rows = df.select(key, F.explode_outer(F.array_distinct(pages)).alias("p"))
    islands = rows.withColumn("g", F.col("p") - F.row_number().over(Window.partitionBy(key).orderBy("p"))).groupBy(key, "g").agg(F.min("p").alias("a"), F.max("p").alias("z"))
    text = F.when(F.col("a") == F.col("z"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("z").cast("string")))
    joined = islands.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("rows"))
    label = F.array_join(F.transform(F.filter("rows", lambda r: r["a"].isNotNull()), lambda r: r["t"]), ", ")
    return joined.select(key, F.when(label == "", "-").otherwise(label).alias("page_ranges"))
