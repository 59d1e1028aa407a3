"""Line filters of extracted page text, as one ordered chain of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import strip

# Glyph codes and page numbers.
GLYPH = r"\(cid:\d+\)"
PAGE_NUMBER = (r"^\d{1,4}$", r"(?i)^(halaman|page|hal\.?)\s*\d+$", r"^[-–—]\s*\d+\s*[-–—]$", r"(?i)^[ivxlcdm]{1,7}$")


def pages_of(docs: DataFrame, source: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of a table as pages: a document is a source, a page its rank in it."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(order))
    return docs.select(F.col(source).alias("source_document"), rank.cast("long").alias("page"), F.col(text).alias("text"))


def lines_of(pages: DataFrame) -> DataFrame:
    """``(source_document, page, line_no, line)`` of stripped, non-empty lines."""
    raw = pages.select("source_document", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    return raw.select("source_document", "page", F.col("line_no").cast("long").alias("line_no"), strip(F.col("raw")).alias("line")).filter("line <> ''")


def is_page_number(line: Column) -> Column:
    out = line.rlike(PAGE_NUMBER[0])
    for p in PAGE_NUMBER[1:]:
        out = out | line.rlike(p)
    return out


def alnum_count(line: Column) -> Column:
    return F.length(F.regexp_replace(line, "[^\\p{L}\\p{N}]", ""))


def consonant_run(word: Column) -> Column:
    """Longest run without a vowel after clusters are one consonant; y is a consonant."""
    out = F.lower(word)
    for c in C.CONSONANT_CLUSTERS:
        out = F.replace(out, F.lit(c), F.lit("c"))
    return F.array_max(F.transform(F.split(out, "[aeiou]"), F.length))


def is_gibberish(line: Column) -> Column:
    """Two tripled letters, or half of three eligible words or more hard to pronounce."""
    words = F.filter(F.regexp_extract_all(line, F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: (F.length(w) >= C.GIBBERISH_WORD_LENGTH) & (w != F.upper(w)))
    odd = F.size(F.filter(words, lambda w: consonant_run(w) >= C.CONSONANT_RUN))
    tripled = F.regexp_count(line, F.lit("([A-Za-z])\\1\\1")) >= 2
    return tripled | ((F.size(words) >= C.GIBBERISH_WORDS) & (odd >= C.GIBBERISH_RATIO * F.size(words)))


def template(line: Column) -> Column:
    """A running line without its numbers: digits and Roman words become ``#``."""
    out = F.regexp_replace(F.lower(line), "\\d+", "#")
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}_])[ivxlcdm]{1,7}(?![\p{L}\p{N}_])", "#")
    return strip(F.regexp_replace(out, "\\s+", " "))


def running_templates(lines: DataFrame) -> DataFrame:
    """``(source_document, template, n)``: page edges that recur through a document."""
    first = Window.partitionBy("source_document", "page").orderBy("line_no")
    last = Window.partitionBy("source_document", "page").orderBy(F.desc("line_no"))
    edges = lines.withColumn("a", F.row_number().over(first)).withColumn("z", F.row_number().over(last)).filter((F.col("a") <= 2) | (F.col("z") <= 2))
    distinct = edges.filter(F.length("line") <= C.TEMPLATE_LENGTH).select("source_document", "page", "line").distinct()
    counts = distinct.groupBy("source_document", template(F.col("line")).alias("template")).agg(F.count("*").alias("n"))
    pages = lines.groupBy("source_document").agg(F.countDistinct("page").alias("pages"))
    least = F.greatest(F.lit(C.TEMPLATE_PAGES), F.floor(F.lit(C.TEMPLATE_RATIO) * F.col("pages")))
    return counts.join(pages, "source_document").filter((F.col("pages") >= C.TEMPLATE_PAGES) & (F.col("n") >= least) & (F.col("template") != "")).select("source_document", "template", "n")


def with_reasons(lines: DataFrame) -> DataFrame:
    """``lines`` with ``drop_reason``, null for lines that stay; the first reason wins."""
    known = running_templates(lines).select("source_document", "template", F.lit(True).alias("running"))
    df = lines.withColumn("template", template(F.col("line"))).join(known, ["source_document", "template"], "left")
    line = F.col("line")
    reason = (
        F.when(line.rlike(GLYPH), "glyph_code").when(is_page_number(line), "page_number").when(F.col("running"), "header_footer")
        .when(alnum_count(line) < C.MIN_ALNUM, "too_short").when(is_gibberish(line), "gibberish")
    )
    df = df.withColumn("reason", reason).withColumn("norm", strip(F.regexp_replace("line", "(?U)\\s+", " ")))
    # Duplicates are judged among the lines that stay; a run of equals keeps its first.
    order = Window.partitionBy("source_document", "page", F.col("reason").isNull()).orderBy("line_no")
    same = F.col("reason").isNull() & (F.lag("norm").over(order) == F.col("norm"))
    return df.select("source_document", "page", "line_no", F.col("norm").alias("line"), F.when(same, "duplicate").otherwise(F.col("reason")).alias("drop_reason"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages rebuilt from the lines that stay; emptied pages are absent."""
    kept = with_reasons(lines_of(pages)).filter("drop_reason is null")
    rows = kept.groupBy("source_document", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    return rows.select("source_document", "page", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def report(reasons: DataFrame) -> DataFrame:
    """Lines by document and reason; ``kept`` for lines that stay."""
    return reasons.groupBy("source_document", F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_lines"))


def noisy_pages(reasons: DataFrame) -> DataFrame:
    pages = reasons.groupBy("source_document", "page").agg(F.count("*").alias("n_lines"), F.count("drop_reason").alias("n_dropped"))
    return pages.filter((F.col("n_lines") >= C.NOISY_LINES) & (F.col("n_dropped") >= C.NOISY_SHARE * F.col("n_lines")))


def most_common_reasons(reasons: DataFrame) -> DataFrame:
    """Dropped lines of the whole corpus by reason, the most frequent first."""
    return reasons.filter("drop_reason is not null").groupBy(F.col("drop_reason").alias("reason")).agg(F.count("*").alias("n_lines")).orderBy(F.desc("n_lines"), "reason")


def noisiest_pages(reasons: DataFrame, n: int = 6) -> DataFrame:
    """The noisy pages that lost most lines, the first ``n``."""
    return noisy_pages(reasons).orderBy(F.desc("n_dropped"), "source_document", "page").limit(n)
