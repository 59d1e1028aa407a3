"""Answer-side operators: citations, guards, query rewriting, reranking, prompts.

Deterministic text rules are column expressions; the lenient rescue of JSON
replies is a vectorised pandas function, as SQL's JSON parser is stricter.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import strip, truncate_words

# The separators and the form of a page citation.
_SEP = r"\s*(?:,|dan|s\.?d\.?|[-–—])\s*"
CITATION = rf"(?i)halaman\s*:?\s*(\d{{1,4}}(?:{_SEP}\d{{1,4}})*)"
# Phrases by which an answer refuses.
REFUSALS = (
    "tidak ditemukan dalam dokumen",
    "tidak ditemukan di dokumen",
    "informasi mengenai hal tersebut tidak ditemukan",
    "hanya dapat menjawab pertanyaan seputar dokumen",
    "hanya dapat menjawab pertanyaan terkait dokumen",
    "di luar cakupan",
    "tidak tercakup dalam dokumen",
    "hubungi bagian akademik",
    "tidak tersedia dalam dokumen",
    "tidak terdapat dalam dokumen",
)
# Words that refer to something said before.
REFERENTIAL = (
    "itu", "tersebut", "tadi", "sebelumnya", "yang mana", "kalau",
    "bagaimana dengan", "gimana dengan", "terus", "lalu", "kemudian",
    "dia", "mereka", "nya", "ini", "begitu", "sama seperti",
    "berapa lama", "kenapa", "mengapa", "apakah begitu", "selain itu",
    "contohnya", "misalnya", "detailnya", "lengkapnya", "bedanya",
)


def cited_pages(answer: Column) -> Column:
    """Sorted distinct pages that an answer cites.

    After the first number each separator and number is folded in: a dash makes
    an ascending range of bounded span or ends the run; others add one page.
    """
    runs = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1))

    def pages(run):
        numbers = F.transform(F.regexp_extract_all(run, F.lit(r"(\d{1,4})"), F.lit(1)), lambda x: x.cast("int"))
        dashes = F.transform(F.slice(F.split(run, r"\d{1,4}"), F.lit(2), F.size(numbers) - 1), lambda s: s.rlike("[-–—]"))
        steps = F.slice(F.zip_with(numbers, F.concat(F.array(F.lit(False)), dashes), lambda n, d: F.struct(n.alias("n"), d.alias("d"))), 2, F.size(numbers))
        zero = F.struct(F.lit(False).alias("stop"), F.element_at(numbers, 1).alias("at"), F.slice(numbers, 1, 1).alias("out"))

        def fold(acc, x):
            bad = x["d"] & ((x["n"] <= acc["at"]) | (x["n"] - acc["at"] > C.CITATION_SPAN))
            stop = acc["stop"] | bad
            more = F.when(x["d"], F.sequence(F.least(acc["at"], x["n"]), x["n"])).otherwise(F.array(x["n"]))
            return F.struct(stop.alias("stop"), F.when(stop, acc["at"]).otherwise(x["n"]).alias("at"), F.when(stop, acc["out"]).otherwise(F.concat(acc["out"], more)).alias("out"))

        return F.aggregate(steps, zero, fold, lambda acc: acc["out"])

    return F.array_sort(F.array_distinct(F.flatten(F.transform(runs, pages))))


def citation_check(cited: Column, context: Column) -> dict[str, Column]:
    """Presence, invalid pages, validity and precision (0 without citations)."""
    invalid = F.array_except(cited, context)
    n = F.size(cited)
    return {
        "has_citation": n > 0,
        "invalid_pages": invalid,
        "citation_valid": (n > 0) & (F.size(invalid) == 0),
        "citation_precision": F.when(n > 0, (n - F.size(invalid)) / n).otherwise(F.lit(0.0)),
    }


def strip_source_lines(answer: Column) -> Column:
    """Without lines that name sources and pages; blank runs are squeezed."""
    kept = F.filter(F.split(answer, "\r\n|\r|\n"), lambda line: ~(F.contains(F.lower(line), F.lit("sumber:")) & F.contains(F.lower(line), F.lit("halaman"))))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def is_refusal(answer: Column) -> Column:
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | F.contains(F.lower(answer), F.lit(phrase))
    return F.coalesce(out, F.lit(False))


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


# Marks of a provider's error text, and the codes they stand for.
ERROR_MARKS = ("⚠️", "not_found", "resource_exhausted", "rate limit", "api key")
PAGE_CITATION = r"(?i)\bhalaman\s*:?\s*\d{1,4}\b"
ERROR_CODES = (
    ("provider_rate_limit", ("quota", "rate limit", "batas penggunaan", "429", "resource_exhausted")),
    ("provider_auth", ("api key", "api_key", "authentication", "401")),
    ("provider_model_or_endpoint", ("404", "not_found", "model not found")),
    ("provider_models_unavailable", ("model_disabled",)),
)


def diagnosis(answer: Column, context: Column) -> Column:
    """Code of the first problem of an answer; null for a sound one."""
    low = F.lower(answer)
    failed = _any(low, ERROR_MARKS)
    out = F.when(F.coalesce(strip(answer), F.lit("")) == "", "empty_response")
    for code, words in ERROR_CODES:
        out = out.when(failed & _any(low, words), code)
    out = out.when(failed, "provider_error").when(~answer.rlike(PAGE_CITATION), "missing_page_citation")
    return out.when(F.size(F.array_except(cited_pages(answer), context)) > 0, "citation_outside_context")


def is_safe(answer: Column) -> Column:
    return F.coalesce((strip(answer) != "") & ~_any(F.lower(answer), ERROR_MARKS) & answer.rlike(PAGE_CITATION), F.lit(False))


def needs_rewrite(query: Column, has_assistant: Column) -> Column:
    """After an assistant turn: short, or with a possessive or a referring word."""
    text = strip(F.coalesce(query, F.lit("")))
    short = F.size(F.split(text, r"(?U)\s+")) <= C.REWRITE_WORDS
    marks = "|".join(re.escape(m) for m in REFERENTIAL)
    return F.coalesce(has_assistant, F.lit(False)) & (text != "") & (short | F.lower(text).rlike(r"(?U)\w{3,}nya\b") | F.lower(text).rlike(rf"(?U)\b(?:{marks})\b"))


def sanitize_rewrite(raw: Column, fallback: Column) -> Column:
    """First line of a reply without quotes and labels; the fallback if empty or overlong."""
    line = F.try_element_at(F.filter(F.split(F.coalesce(raw, F.lit("")), "\r\n|\r|\n"), lambda x: strip(x) != ""), F.lit(1))
    text = strip(F.regexp_replace(strip(line), "^[\"'`]+|[\"'`]+$", ""))
    # Labels that a rewriter may put first.
    text = strip(F.regexp_replace(text, r"(?i)^(pertanyaan mandiri|hasil penulisan ulang|query|jawaban)\s*[:\-]\s*", ""))
    most = F.greatest(F.lit(C.REWRITE_FLOOR), F.length(fallback) * C.REWRITE_FACTOR)
    return F.when(F.coalesce(text, F.lit("")) == "", fallback).when(F.length(text) > most, fallback).otherwise(text)


def history_window(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", n: int = C.HISTORY_MESSAGES) -> DataFrame:
    """Each message with the ``n`` messages before it, and whether the assistant has spoken."""
    order = Window.partitionBy(conv).orderBy(turn)
    past = order.rowsBetween(-n, -1)
    ever = order.rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("history", F.collect_list(F.struct(turn, "role", "text")).over(past)).withColumn("has_assistant", F.coalesce(F.max((F.col("role") == "assistant").cast("int")).over(ever), F.lit(0)) == 1)


def history_prompt(history: Column, query: Column) -> Column:
    """Labelled, truncated messages and the question."""
    lines = F.transform(history, lambda m: F.concat(F.when(m["role"] == "user", "Pengguna: ").otherwise("Asisten: "), truncate_words(strip(m["text"]), C.HISTORY_CHARS)))
    return F.concat(F.lit("Riwayat percakapan:\n"), F.array_join(lines, "\n"), F.lit("\n\nPertanyaan terakhir: "), query)


def _json_of(raw: str | None, opening: str, closing: str):
    text = (raw or "").strip()
    if text.startswith("```"):
        text = re.sub(r"^```[A-Za-z]*\s*|\s*```$", "", text).strip()
    for part in (text, text[text.find(opening) : text.rfind(closing) + 1]):
        try:
            return json.loads(part)
        except ValueError:
            continue
    return None


def _number(value) -> float | None:
    try:
        x = float(value)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(x) else max(0.0, min(10.0, x))


def scores_of(raw: str | None, expected: int) -> dict[int, float]:
    """Candidate number (from 1) to score; unusable entries and NaN are left out."""
    data = _json_of(raw, "[", "]")
    if isinstance(data, dict):
        data = next((v for v in data.values() if isinstance(v, list)), None)
    out = {}
    for entry in data if isinstance(data, list) else ():
        if isinstance(entry, dict):
            try:
                n = int(entry.get("id"))
            except (TypeError, ValueError):
                continue
            score = _number(entry.get("score"))
            if score is not None and 1 <= n <= expected:
                out[n] = score
    return out


def verdict_of(raw: str | None) -> tuple[float | None, list[str], bool]:
    """(score, unsupported claims, judge failed); a failure is not a score of zero."""
    data = _json_of(raw, "{", "}")
    score = _number(data.get("score")) if isinstance(data, dict) else None
    if score is None:
        return None, [], True
    claims = data.get("unsupported_claims")
    return score, [str(c) for c in claims] if isinstance(claims, list) else [], False


def parse_scores(raw, expected) -> Column:
    """Map of candidate number to score."""

    @F.pandas_udf("map<int,double>")
    def run(raw: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series([scores_of(r, int(n)) for r, n in zip(raw, expected)])

    return run(raw, expected)


def parse_verdict(raw) -> Column:
    """Struct of score, unsupported claims and whether the judge failed."""

    @F.pandas_udf("struct<score:double,unsupported_claims:array<string>,judge_failed:boolean>")
    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verdict_of(r) for r in raw], columns=["score", "unsupported_claims", "judge_failed"])

    return run(raw)


def apply_scores(cands: DataFrame, replies: DataFrame, q_id: str = "q_id") -> DataFrame:
    """Reranked candidates ``(…, rerank_score, rerank_ok, single, rerank_rank)``.

    ``replies(q_id, reply)``.  One candidate is left alone; a reply without any
    score leaves the fusion order and null scores; otherwise a missing
    candidate scores 0.0.
    """
    sizes = cands.groupBy(q_id).agg(F.count("*").cast("int").alias("n"))
    parsed = sizes.join(replies, q_id, "left").select(q_id, "n", parse_scores("reply", "n").alias("scores"))
    df = cands.join(parsed, q_id).withColumn("single", F.col("n") <= 1)
    df = df.withColumn("rerank_ok", F.col("single") | (F.coalesce(F.size("scores"), F.lit(0)) > 0))
    score = F.coalesce(F.try_element_at("scores", F.col("fusion_rank").cast("int")), F.lit(0.0))
    df = df.withColumn("rerank_score", F.when(~F.col("single") & F.col("rerank_ok"), score)).drop("scores", "n")
    order = Window.partitionBy(q_id).orderBy(F.desc_nulls_last("rerank_score"), "fusion_rank")
    return df.withColumn("rerank_rank", F.row_number().over(order).cast("long"))


def rerank_prompts(cands: DataFrame, q_id: str = "q_id", query: str = "query", text: str = "text") -> DataFrame:
    """One listwise prompt for each question with two candidates or more."""
    snippet = F.concat(F.lit("["), F.col("fusion_rank").cast("string"), F.lit("] "), truncate_words(strip(F.regexp_replace(text, r"(?U)\s+", " ")), C.RERANK_SNIPPET))
    grouped = cands.groupBy(q_id).agg(F.first(query).alias("query"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("fusion_rank", snippet.alias("s")))).alias("rows")).filter("n > 1")
    return grouped.select(q_id, F.concat(F.lit("Pertanyaan: "), "query", F.lit("\n\nKandidat:\n"), F.array_join(F.transform("rows", lambda r: r["s"]), "\n\n")).alias("prompt"))


def answer_prompts(contexts: DataFrame, q_id: str = "q_id", histories: DataFrame | None = None) -> DataFrame:
    """One answer prompt for each question: numbered contexts, history, the question, distinct citation lines.

    ``contexts(q_id, query, final_rank, document_label, page_label, section_title, text)``;
    ``histories(q_id, history)`` has the messages before it, of which the last few are quoted.
    """
    source = F.concat_ws(", ", "document_label", F.concat(F.lit("Halaman "), "page_label"), F.when(F.col("section_title") != "", F.col("section_title")))
    block = F.concat(F.lit("[Konteks "), F.col("final_rank").cast("string"), F.lit(" | "), source, F.lit("]\n"), F.coalesce("text", F.lit("")))
    grouped = contexts.groupBy(q_id).agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("final_rank", block.alias("b"), source.alias("s")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["b"]), "\n\n---\n\n")
    cites = F.array_join(F.array_distinct(F.transform("rows", lambda r: F.concat(F.lit("- "), r["s"]))), "\n")
    if histories is not None:
        grouped = grouped.join(histories.select(q_id, "history"), q_id, "left")
        recent = F.slice("history", F.greatest(F.lit(1), F.size("history") - C.HISTORY_MESSAGES + 1), F.lit(C.HISTORY_MESSAGES))
        said = F.array_join(F.transform(recent, lambda m: F.concat(F.when(m["role"] == "user", "Pengguna: ").otherwise("Asisten: "), F.coalesce(m["text"], F.lit("")))), "\n")
        past = F.when(F.coalesce(F.size("history"), F.lit(0)) > 0, F.concat(F.lit("\n\nRiwayat percakapan terkini:\n"), said)).otherwise("")
    else:
        past = F.lit("")
    return grouped.select(q_id, F.concat(F.lit("Konteks:\n"), body, past, F.lit("\n\nPertanyaan: "), F.coalesce("query", F.lit("")), F.lit("\n\nSitasi yang boleh dipakai:\n"), cites).alias("prompt"))


def judge_prompts(contexts: DataFrame, generated: DataFrame, q_id: str = "q_id") -> DataFrame:
    """One prompt for each answer that a judge can compare with its numbered, truncated sources.

    ``contexts(q_id, final_rank, page_label, text)``, ``generated(q_id, query, answer)``.
    """
    block = F.concat(F.lit("[Sumber "), F.col("final_rank").cast("string"), F.lit(" | Halaman "), "page_label", F.lit("]\n"), truncate_words(strip(F.coalesce("text", F.lit(""))), C.JUDGE_CONTEXT))
    rows = contexts.groupBy(q_id).agg(F.array_sort(F.collect_list(F.struct("final_rank", block.alias("b")))).alias("rows"))
    sources = F.array_join(F.transform("rows", lambda r: r["b"]), "\n\n")
    asked = generated.filter(F.coalesce("answer", F.lit("")) != "").join(rows, q_id)
    return asked.select(q_id, F.concat(F.lit("Pertanyaan: "), F.coalesce("query", F.lit("")), F.lit("\n\nSumber:\n"), sources, F.lit("\n\nJawaban yang dinilai:\n"), "answer", F.lit("\n\nBalas hanya dengan JSON.")).alias("prompt"))


def is_grounded(score: Column) -> Column:
    """A judged answer of at least the pass mark; without a score it is not."""
    return F.coalesce(score >= C.JUDGE_PASS, F.lit(False))


def no_context_answer() -> str:
    """The fixed refusal that needs no provider."""
    return "Maaf, informasi mengenai hal tersebut tidak ditemukan dalam dokumen yang tersedia."


def unverified_answer() -> str:
    """What stands in for an answer that fails its checks."""
    return "Maaf, jawaban yang dapat diverifikasi belum tersedia. Silakan coba lagi nanti."


def cited_contexts(contexts: DataFrame, pages: str = "page_numbers", cited: str = "cited_pages") -> DataFrame:
    """Contexts that share a page with the citations, their pages cut to those; all of them where nothing is cited."""
    none = F.size(cited) == 0
    kept = contexts.filter(none | F.arrays_overlap(pages, cited))
    return kept.withColumn(pages, F.when(none, F.col(pages)).otherwise(F.array_intersect(pages, cited)))


def source_cards(contexts: DataFrame, q_id: str = "q_id") -> DataFrame:
    """By question and document: union of pages, best section and score, first-seen order.

    ``contexts(q_id, final_rank, source_document, page_numbers, section_title, score)``.
    """
    first = F.struct(F.col("score").alias("s"), (-F.col("final_rank")).alias("r"))
    grouped = contexts.groupBy(q_id, "source_document").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("pages"), F.max_by("section_title", first).alias("section_title"), F.max("score").alias("score"), F.min("final_rank").alias("seen")
    )
    order = Window.partitionBy(q_id).orderBy("seen")
    return grouped.select(q_id, F.row_number().over(order).cast("long").alias("card_no"), "source_document", "pages", "section_title", F.round("score", 4).alias("score"))
