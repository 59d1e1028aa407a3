"""Queries of the answer-side, evaluation, provenance and rate-limit operators."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import RetrievalConfig
from ..functions.text import strip, truncate_words
from ..operators import answers, evaluate, fusion, lexical
from ..sources import files
from ..streaming import limiter
from . import duck
from .retrieval import stored_index

TALK = (
    (1, "Berapa syaratnya?", True, True),
    (2, "Berapa syaratnya?", False, False),
    (3, "Apakah mahasiswa dapat mengajukan cuti pada semester pertama", True, False),
    (4, "Berapa besar biayanya untuk mahasiswa angkatan baru", True, True),
    (5, "Jelaskan aturan tersebut untuk mahasiswa lintas jalur", True, True),
    (6, "   ", True, False),
)
QUOTE = object()
# Answers in parts: text, the quote, or a number that is added to the document's page.
FORMS = (
    (QUOTE, " (Halaman ", 0, ")."), ("Lihat Halaman ", 0, "-", 2, "."), ("Lihat halaman: ", 0, ", ", 1, " dan ", 2, "."), ("Halaman ", 0, " — 5. ", QUOTE), ("Halaman ", 0, " s.d. ", 2), (QUOTE,), ("",), ("Halaman ", 0, " – ", 87),
    ("Provider: rate limit tercapai ", QUOTE), ("api key salah",), ("Halaman ", 0, ". Lalu HALAMAN ", 2, " dan ", 2, "."), ("Maaf, ", QUOTE, " tidak ditemukan dalam dokumen."), (QUOTE, "\nSumber: buku, Halaman ", 0), ("  Satu ", QUOTE, "\n\n\n\nDua  "),
    ("sumber: tanpa nomor\n", QUOTE, "\n(Sumber: A, halaman ", 3, ")\nlagi"), ("HALAMAN ", 40, "–", 2, ", ", 7),
)
# Replies in parts: text, or the name of a column.
REPLIES = (
    ('[{"id": 1, "score": ', "a", '}, {"id": 2, "score": ', "b", ".5}]"), ('```json\n[{"id": 1, "score": 1', "a", '}, {"id": 9, "score": 2}, {"id": 2, "score": -', "b", "}]\n```"), ('Hasil: [{"id": "2", "score": "', "a", '"}, {"id": 1, "score": null}] selesai',),
    ('{"hasil": [{"id": 3, "score": ', "b", "}]}"), ("text",), ('[{"id": 1, "score": NaN}, 5, {"id": 2}]',), ('[{"id": 1, "score": ', "a", '}, {"id": 1, "score": ', "b", "}]"),
)
LIMIT, WINDOW = 2, 86_400
CARD_HITS = 10


def _table(spark: SparkSession, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _answers(spark, sf):
    """Answers built from every document: a quote of it, and citations of its page in all forms that the rules know."""
    page = (F.pmod("doc_id", F.lit(997)) + 1).cast("int")
    docs = _table(spark, sf, "documents").select("doc_id", page.alias("p"), F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), "\n", " ").alias("quote"))
    forms = F.array(*[F.concat(*[F.lit(x) if isinstance(x, str) else (F.col("quote") if x is QUOTE else (F.col("p") + x).cast("string")) for x in form]) for form in FORMS])
    rows = docs.select("doc_id", "p", F.posexplode(forms).alias("form", "answer"))
    context = F.array(F.col("p"), F.col("p") + 1)
    return rows.select("doc_id", F.col("form").cast("long").alias("form"), "answer", context.alias("context"), answers.cited_pages(F.col("answer")).alias("cited"))


def cited_pages(spark, sf):
    return _answers(spark, sf).select("doc_id", "form", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"))


def citation_check(spark, sf):
    c = answers.citation_check(F.col("cited"), F.col("context"))
    return _answers(spark, sf).select("doc_id", "form", c["has_citation"].alias("has_citation"), F.array_join(c["invalid_pages"].cast("array<string>"), ",").alias("invalid_pages"), c["citation_valid"].alias("citation_valid"), F.round(c["citation_precision"], 6).alias("citation_precision"))


def answer_diagnosis(spark, sf):
    return _answers(spark, sf).select("doc_id", "form", F.coalesce(answers.diagnosis(F.col("answer"), F.col("context")), F.lit("")).alias("code"), answers.is_safe(F.col("answer")).alias("is_safe"))


def strip_sources(spark, sf):
    return _answers(spark, sf).select("doc_id", "form", answers.strip_source_lines(F.col("answer")).alias("answer"))


def refusal_detect(spark, sf):
    """Refusal phrases over conversation texts and the answers built from documents."""
    talk = _table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("answer"))
    own = _answers(spark, sf).select((-1 - F.col("doc_id") * len(FORMS) - F.col("form")).alias("id"), "answer")
    return talk.unionByName(own).select("id", answers.is_refusal(F.col("answer")).alias("refused"))


def rewrite_needed(spark, sf):
    """User turns of the table and the fixture, with whether they need their history."""
    talk = answers.history_window(_table(spark, sf, "conversations")).filter("role = 'user'")
    a = talk.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), answers.needs_rewrite(F.col("text"), F.col("has_assistant")).alias("needs_rewrite"))
    own = spark.createDataFrame([(-i, q, h) for i, q, h, _ in TALK], "id long, q string, h boolean")
    return a.unionByName(own.select("id", answers.needs_rewrite(F.col("q"), F.col("h")).alias("needs_rewrite")))


def history_window(spark, sf):
    h = answers.history_window(_table(spark, sf, "conversations"))
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n_history"), F.coalesce(F.get(F.transform("history", lambda m: m["turn"]), F.lit(0)), F.lit(-1)).alias("first_turn"), "has_assistant")


def conversation_answers(spark, sf):
    """The answer rules over every assistant turn; the pages of its context are the turns before it.

    ``n_scores`` is what the text yields when read as a rerank reply of 20 candidates.
    """
    talk = answers.history_window(_table(spark, sf, "conversations")).filter("role = 'assistant'")
    context = F.transform("history", lambda m: m["turn"].cast("int"))
    rows = talk.select("conv_id", "turn", F.col("text").alias("answer"), context.alias("context"), answers.cited_pages(F.col("text")).alias("cited"))
    c = answers.citation_check(F.col("cited"), F.col("context"))
    return rows.select(
        "conv_id", "turn", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), c["citation_valid"].alias("citation_valid"), F.round(c["citation_precision"], 6).alias("citation_precision"),
        F.coalesce(answers.diagnosis(F.col("answer"), F.col("context")), F.lit("")).alias("code"), answers.strip_source_lines(F.col("answer")).alias("answer"), F.coalesce(F.size(answers.parse_scores("answer", F.lit(20))), F.lit(0)).cast("long").alias("n_scores"),
    )


def _replies(spark, sf):
    """Rerank replies built from every turn, well-formed and not, with the number of candidates."""
    n = F.length(F.coalesce("text", F.lit("")))
    rows = _table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("q_id"), F.when(F.col("turn") == 0, 1).otherwise(3).alias("n"), (n % 11).alias("a"), (F.floor(n / 11) % 11).alias("b"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.pmod("q_id", F.lit(len(REPLIES)))
    reply = F.coalesce(*[F.when(number == i, F.concat(*[F.col(x) if x in ("a", "b", "text") else F.lit(x) for x in form])) for i, form in enumerate(REPLIES)])
    return rows.select("q_id", "n", reply.alias("reply"))


def rerank_parse(spark, sf):
    return _replies(spark, sf).select("q_id", F.explode(answers.parse_scores("reply", F.lit(3))).alias("candidate", "score")).select("q_id", F.col("candidate").cast("long").alias("candidate"), "score")


def rerank_apply(spark, sf):
    """Three candidates a turn, one for the first turn of a conversation; scores from the replies."""
    replies = _replies(spark, sf)
    cands = replies.select("q_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("fusion_rank")).select("q_id", (F.col("q_id") * 10 + F.col("fusion_rank")).alias("doc_id"), "fusion_rank")
    out = answers.apply_scores(cands, replies.select("q_id", "reply"))
    verdict = fusion.rerank_gate(out, RetrievalConfig())
    return out.join(verdict, "q_id").select("q_id", "doc_id", "rerank_score", "rerank_ok", "rerank_rank", "rerank_pass")


def retrieved_source_cards(spark, sf):
    """Cards of the best BM25 hits of each item over the whole table; a page is a document's rank in its source."""
    docs = _table(spark, sf, "documents")
    hits = lexical.ranked(_table(spark, sf, "benchmark"), stored_index(spark, sf), CARD_HITS).select(F.col("item_id").alias("q_id"), "doc_id", F.col("lexical_rank").alias("final_rank"), "score")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    pages = docs.select("doc_id", F.col("source").alias("source_document"), F.col("lang").alias("section_title"), F.array(rank.cast("long")).alias("page_numbers"))
    cards = answers.source_cards(hits.join(pages, "doc_id"))
    return cards.select("q_id", "card_no", "source_document", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "section_title", "score")


def _results(spark, sf):
    """Label rows as scored questions: quality tells the scope, toxic a refusal."""
    docs, labels = _table(spark, sf, "documents").select("doc_id", "n_chars"), _table(spark, sf, "labels")
    d = F.col("doc_id")
    return docs.join(labels, "doc_id").select(
        F.when(d % 2 == 0, "dense").otherwise("hybrid").alias("preset"), F.when(F.col("quality") == 1, "in_scope").otherwise("out_of_scope").alias("category"), (F.col("toxic") == 1).alias("refused"),
        (d % 3 != 0).alias("has_expected_pages"), (d % 4 != 0).alias("page_hit"), (d % 5 != 0).alias("has_keywords"), (d % 7 != 0).alias("keyword_hit"), (d % 6 == 0).alias("is_conversational"), (d % 11 == 0).alias("rerank_failed"),
        F.when(d % 4 != 0, 1.0 / (d % 4)).otherwise(0.0).alias("reciprocal_rank"), F.col("n_chars").cast("double").alias("latency_ms"), (d % 13 == 0).alias("generation_failed"), (d % 9 == 0).alias("judge_failed"),
        F.when(d % 9 != 0, (d % 11).cast("double")).alias("groundedness_score"), (d % 11 >= 7).alias("grounded"), (d % 8 != 0).alias("has_citation"), (d % 8 > 2).alias("citation_valid"), ((d % 8) / 8.0).alias("citation_precision"), (d % 3 == 1).alias("cites_expected_page"),
    )


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def retrieval_metrics(spark, sf):
    return _rounded(evaluate.retrieval_metrics(_results(spark, sf)))


def answer_metrics(spark, sf):
    return _rounded(evaluate.answer_metrics(_results(spark, sf)))


def truncated_texts(spark, sf):
    """Turns cut at a word to at most 40 characters, as prompts cut theirs."""
    return _table(spark, sf, "conversations").select("conv_id", "turn", truncate_words(strip(F.coalesce("text", F.lit(""))), 40).alias("text"))


def sanitized_rewrites(spark, sf):
    """Replies of a rewriter built from every turn, good and useless ones, with the turn as the fallback."""
    text = F.coalesce("text", F.lit(""))
    forms = F.array(F.concat(F.lit('"'), text, F.lit('"')), F.concat(F.lit("Query: "), text, F.lit("\nlain")), F.concat(F.lit(" \n\n  "), text), F.lit("  \n "), F.repeat(text, 9), F.concat(F.lit("Pertanyaan mandiri - `"), text, F.lit("`")))
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", text.alias("q"), F.posexplode(forms).alias("form", "raw"))
    return rows.select("conv_id", "turn", F.col("form").cast("long").alias("form"), answers.sanitize_rewrite(F.col("raw"), F.col("q")).alias("query"))


def stage_totals(spark, sf):
    """Sums of stage timings; a document's numbers stand in for milliseconds."""
    size = F.coalesce("n_chars", F.lit(0)).cast("double")
    timings = F.create_map(F.lit("dense_ms"), size / 8, F.lit("lexical_ms"), size / 4, F.lit("fuse_ms"), F.lit(0.5))
    return _table(spark, sf, "documents").select("doc_id", F.round(evaluate.total_ms(timings), 6).alias("total_ms"))


def index_freshness(spark, sf):
    """An index of every document against files: texts with white space run together, no short ones, and the web pages."""
    docs = _table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("text"), "n_chars")
    indexed = docs.select("name", files.fingerprint(F.col("text").cast("binary")).alias("sha256"))
    now = docs.filter("n_chars >= 50").select("name", files.fingerprint(F.regexp_replace("text", "[ \n]+", " ").cast("binary")).alias("sha256"))
    pages = _table(spark, sf, "pages").select(F.concat(F.lit("page-"), "page_id").alias("name"), files.fingerprint(F.coalesce("html", F.lit("")).cast("binary")).alias("sha256"))
    return files.freshness(indexed, now.unionByName(pages))


def index_stale(spark, sf):
    return files.is_stale(index_freshness(spark, sf))


def rate_limit(spark, sf):
    return limiter.rate_limit(_table(spark, sf, "events"), LIMIT, WINDOW)


QUERIES = {f.__name__: f for f in (cited_pages, citation_check, answer_diagnosis, strip_sources, refusal_detect, rewrite_needed, history_window, conversation_answers, rerank_parse, rerank_apply, retrieved_source_cards, retrieval_metrics, answer_metrics, truncated_texts, sanitized_rewrites, stage_totals, index_freshness, index_stale, rate_limit)}


def _q(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return {True: "true", False: "false"}[value] if isinstance(value, bool) else repr(value)


def _values(rows, columns: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) t({columns})"


_REFUSED = " OR ".join(f"contains(lower(answer), '{p}')" for p in answers.REFUSALS)
_MARKS = "|".join(answers.REFERENTIAL)
_W = r"[\p{L}\p{N}_]"
NEEDS_REWRITE = rf"h AND trim(q) <> '' AND (len(string_split_regex(trim(regexp_replace(q, '\s+', ' ', 'g')), ' ')) <= 4 OR regexp_matches(lower(q), '{_W}{{3,}}nya([^\p{{L}}\p{{N}}_]|$)') OR regexp_matches(lower(q), '(^|[^\p{{L}}\p{{N}}_])({_MARKS})([^\p{{L}}\p{{N}}_]|$)'))"
_RESULTS = """r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'dense' ELSE 'hybrid' END AS preset, quality = 1 AS inside, toxic = 1 AS refused, doc_id AS d, CAST(n_chars AS DOUBLE) AS latency FROM documents JOIN labels USING (doc_id))"""


def _share(a: str, b: str) -> str:
    return f"round(CASE WHEN count(*) FILTER ({b}) > 0 THEN count(*) FILTER (({a}) AND ({b})) / count(*) FILTER ({b})::DOUBLE ELSE 0e0 END, 6)"


def _text_of(form, replies: bool = False) -> str:
    part = lambda x: "quote" if x is QUOTE else (x if replies and x in ("a", "b", "text") else _q(x)) if isinstance(x, str) else f"(p + {x})"
    return "concat(" + ", ".join(map(part, form)) + ")"


def sanitized(raw: str, q: str) -> str:
    """``sanitize_rewrite`` in SQL."""
    line = f"list_filter(string_split_regex({raw}, '\\r\\n|\\r|\\n'), lambda x: {duck.strip('x')} <> '')[1]"
    bare = duck.strip(f"regexp_replace({duck.strip(line)}, '^[\"''`]+|[\"''`]+$', '', 'g')")
    label = r"(?i)^(pertanyaan mandiri|hasil penulisan ulang|query|jawaban)\s*[:\-]\s*"
    text = duck.strip(f"regexp_replace({bare}, '{label}', '')")
    return f"CASE WHEN coalesce({text}, '') = '' OR length({text}) > greatest(240, 6 * length({q})) THEN {q} ELSE {text} END"


_ANSWERS = f"""dq AS (SELECT doc_id, doc_id % 997 + 1 AS p, replace(left(coalesce(text, ''), 60), chr(10), ' ') AS quote FROM documents),
        an AS ({" UNION ALL ".join(f"SELECT doc_id, CAST({i} AS BIGINT) AS form, {_text_of(f)} AS answer, [CAST(p AS INT), CAST(p + 1 AS INT)] AS ctx FROM dq" for i, f in enumerate(FORMS))})"""
_CITED = duck.cited("answer")
_ERROR = " OR ".join(f"contains(lower(answer), '{m}')" for m in answers.ERROR_MARKS)
_CODES = " ".join(f"WHEN ({_ERROR}) AND ({' OR '.join(f"contains(lower(answer), '{w}')" for w in ws)}) THEN '{code}'" for code, ws in answers.ERROR_CODES)
_PAGE = r"(?i)\bhalaman\s*:?\s*\d{1,4}\b"
# The list in a reply: the text between the first and the last bracket, if it is JSON; the last score of a candidate counts.
_PARSED = f"""rp AS (
            SELECT conv_id * 100 + turn AS q_id, CASE WHEN turn = 0 THEN 1 ELSE 3 END AS n, CASE (conv_id * 100 + turn) % {len(REPLIES)} {" ".join(f"WHEN {i} THEN {_text_of(f, True)}" for i, f in enumerate(REPLIES))} END AS reply
            FROM (SELECT *, length(coalesce(text, '')) % 11 AS a, length(coalesce(text, '')) // 11 % 11 AS b FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations))),
        es AS (SELECT q_id, unnest(json_extract(j, '$[*]')) AS e, unnest(range(len(json_extract(j, '$[*]')))) AS k FROM (SELECT q_id, TRY_CAST(nullif(regexp_extract(reply, '\\[.*\\]', 0, 's'), '') AS JSON) AS j FROM rp) WHERE j IS NOT NULL),
        sc AS (SELECT q_id, k, TRY_CAST(e ->> '$.id' AS BIGINT) AS c, TRY_CAST(e ->> '$.score' AS DOUBLE) AS s FROM es WHERE json_type(e) = 'OBJECT'),
        p AS (SELECT q_id, c, arg_max(greatest(0e0, least(10e0, s)), k) AS s FROM sc WHERE c BETWEEN 1 AND 3 AND s IS NOT NULL AND NOT isnan(s) GROUP BY q_id, c)"""
_FRESH = """fr AS (
            SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'untracked' WHEN b.name IS NULL THEN 'missing' WHEN a.s <> b.s THEN 'changed' ELSE 'unchanged' END AS status
            FROM (SELECT 'doc-' || doc_id AS name, sha256(coalesce(text, '')) AS s FROM documents) a
            FULL JOIN (SELECT 'doc-' || doc_id AS name, sha256(regexp_replace(coalesce(text, ''), '[ \n]+', ' ', 'g')) AS s FROM documents WHERE n_chars >= 50
                       UNION ALL SELECT 'page-' || page_id, sha256(coalesce(html, '')) FROM pages) b ON a.name = b.name)"""
_OK = "d % 13 <> 0"
_ANSWERED = f"{_OK} AND inside AND NOT refused"
ORACLE_SQL = {
    "cited_pages": f"WITH {_ANSWERS} SELECT doc_id, form, array_to_string({_CITED}, ',') AS cited FROM an",
    "citation_check": f"""WITH {_ANSWERS}, c AS (SELECT doc_id, form, ctx, {_CITED} AS cites FROM an), k AS (SELECT *, list_filter(cites, lambda p: NOT list_contains(ctx, p)) AS bad FROM c)
        SELECT doc_id, form, len(cites) > 0 AS has_citation, array_to_string(bad, ',') AS invalid_pages, len(cites) > 0 AND len(bad) = 0 AS citation_valid, round(CASE WHEN len(cites) > 0 THEN (len(cites) - len(bad)) / len(cites)::DOUBLE ELSE 0e0 END, 6) AS citation_precision FROM k""",
    "answer_diagnosis": f"""WITH {_ANSWERS}
        SELECT doc_id, form, CASE WHEN {duck.strip("answer")} = '' THEN 'empty_response' {_CODES} WHEN {_ERROR} THEN 'provider_error' WHEN NOT regexp_matches(answer, '{_PAGE}') THEN 'missing_page_citation'
               WHEN len(list_filter({_CITED}, lambda p: NOT list_contains(ctx, p))) > 0 THEN 'citation_outside_context' ELSE '' END AS code, {duck.strip("answer")} <> '' AND NOT ({_ERROR}) AND regexp_matches(answer, '{_PAGE}') AS is_safe FROM an""",
    "strip_sources": f"""WITH {_ANSWERS} SELECT doc_id, form, {duck.strip("regexp_replace(array_to_string(list_filter(string_split(answer, chr(10)), lambda x: NOT (contains(lower(x), 'sumber:') AND contains(lower(x), 'halaman'))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} AS answer FROM an""",
    "refusal_detect": f"WITH {_ANSWERS} SELECT id, coalesce({_REFUSED}, false) AS refused FROM (SELECT conv_id * 1000 + turn AS id, text AS answer FROM conversations UNION ALL SELECT -1 - doc_id * {len(FORMS)} - form, answer FROM an)",
    "conversation_answers": f"""WITH t AS (
            SELECT conv_id, turn, role, text AS answer, coalesce(list(CAST(turn AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS ctx FROM conversations),
        c AS (SELECT *, {_CITED} AS cites, TRY_CAST(nullif(regexp_extract(coalesce(answer, ''), '\\[.*\\]', 0, 's'), '') AS JSON) AS j FROM t WHERE role = 'assistant'),
        k AS (SELECT *, list_filter(cites, lambda p: NOT list_contains(ctx, p)) AS bad,
                     list_filter(json_extract(j, '$[*]'), lambda e: json_type(e) = 'OBJECT' AND TRY_CAST(e ->> '$.id' AS BIGINT) BETWEEN 1 AND 20 AND NOT isnan(coalesce(TRY_CAST(e ->> '$.score' AS DOUBLE), 'nan'::DOUBLE))) AS es FROM c)
        SELECT conv_id, turn, array_to_string(cites, ',') AS cited, len(cites) > 0 AND len(bad) = 0 AS citation_valid, round(CASE WHEN len(cites) > 0 THEN (len(cites) - len(bad)) / len(cites)::DOUBLE ELSE 0e0 END, 6) AS citation_precision,
               CASE WHEN {duck.strip("coalesce(answer, '')")} = '' THEN 'empty_response' {_CODES} WHEN {_ERROR} THEN 'provider_error' WHEN NOT regexp_matches(answer, '{_PAGE}') THEN 'missing_page_citation' WHEN len(bad) > 0 THEN 'citation_outside_context' ELSE '' END AS code,
               {duck.strip("regexp_replace(array_to_string(list_filter(string_split(answer, chr(10)), lambda x: NOT (contains(lower(x), 'sumber:') AND contains(lower(x), 'halaman'))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} AS answer,
               CAST(coalesce(len(list_distinct(list_transform(es, lambda e: TRY_CAST(e ->> '$.id' AS BIGINT)))), 0) AS BIGINT) AS n_scores FROM k""",
    "rewrite_needed": f"""SELECT id, coalesce({NEEDS_REWRITE}, false) AS needs_rewrite FROM (
        SELECT conv_id * 1000 + turn AS id, role, text AS q, coalesce(bool_or(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS h FROM conversations
        UNION ALL SELECT -id, 'user', q, h FROM {_values([t[:3] for t in TALK], "id, q, h")}) WHERE role = 'user'""",
    "history_window": """SELECT conv_id, turn, count(*) OVER w AS n_history, coalesce(first_value(turn) OVER w, -1) AS first_turn,
        coalesce(bool_or(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS has_assistant
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
    "rerank_parse": f"WITH {_PARSED} SELECT q_id, c AS candidate, s AS score FROM p",
    "rerank_apply": f"""WITH {_PARSED},
        c AS (SELECT q_id, n, unnest(range(1, n + 1)) AS r FROM rp),
        j AS (SELECT c.q_id, c.n, r, c.n = 1 OR EXISTS (SELECT 1 FROM p WHERE p.q_id = c.q_id AND p.c <= c.n) AS ok, s FROM c LEFT JOIN p ON p.q_id = c.q_id AND p.c = c.r),
        k AS (SELECT q_id, r, ok, CASE WHEN n > 1 AND ok THEN coalesce(s, 0e0) END AS s FROM j),
        g AS (SELECT q_id, CASE WHEN bool_and(ok) AND count(*) > 1 THEN bool_or(coalesce(s, 0) >= 4) END AS pass FROM k GROUP BY q_id)
        SELECT k.q_id, 10 * k.q_id + r AS doc_id, s AS rerank_score, ok AS rerank_ok, row_number() OVER (PARTITION BY k.q_id ORDER BY s DESC NULLS LAST, r) AS rerank_rank, pass AS rerank_pass FROM k JOIN g ON g.q_id = k.q_id""",
    "retrieved_source_cards": f"""WITH {duck.bm25()},
        top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM hits),
        pg AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pg FROM documents),
        g AS (SELECT item_id AS q_id, source, list_sort(list(DISTINCT pg)) AS pages, arg_max(lang, struct_pack(s := score, r := -rk)) AS section_title, max(score) AS score, min(rk) AS seen FROM top JOIN pg USING (doc_id) WHERE rk <= {CARD_HITS} GROUP BY ALL)
        SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY seen) AS card_no, source AS source_document, array_to_string(pages, ',') AS pages, section_title, round(score, 4) AS score FROM g""",
    "retrieval_metrics": f"""WITH {_RESULTS} SELECT preset, count(*) FILTER (d % 11 = 0) AS rerank_failures, count(*) FILTER (inside AND d % 3 <> 0 AND d % 4 <> 0) AS page_recall_hits, count(*) FILTER (inside AND d % 3 <> 0) AS page_recall_total,
        round(coalesce(avg(CASE WHEN d % 4 <> 0 THEN 1e0 / (d % 4) ELSE 0e0 END) FILTER (inside AND d % 3 <> 0), 0e0), 6) AS mrr, count(*) FILTER (inside AND d % 5 <> 0 AND d % 7 <> 0) AS keyword_hits, count(*) FILTER (inside AND d % 5 <> 0) AS keyword_total,
        count(*) FILTER (NOT inside AND refused) AS correct_refusals, count(*) FILTER (NOT inside) AS out_of_scope_total, count(*) FILTER (inside AND refused) AS false_refusals, count(*) FILTER (inside) AS in_scope_total,
        count(*) FILTER (inside AND d % 6 = 0 AND d % 4 <> 0) AS conversational_hits, count(*) FILTER (inside AND d % 6 = 0) AS conversational_total, round(avg(latency), 6) AS avg_latency_ms, round(median(latency), 6) AS median_latency_ms,
        {_share("d % 4 <> 0", "inside AND d % 3 <> 0")} AS page_recall, {_share("d % 7 <> 0", "inside AND d % 5 <> 0")} AS keyword_coverage, {_share("refused", "NOT inside")} AS refusal_accuracy, {_share("refused", "inside")} AS false_refusal_rate, {_share("d % 4 <> 0", "inside AND d % 6 = 0")} AS conversational_recall
        FROM r GROUP BY preset""",
    "answer_metrics": f"""WITH {_RESULTS} SELECT preset, count(*) AS total, count(*) FILTER (d % 13 = 0) AS generation_failures, count(*) FILTER ({_OK} AND inside) AS in_scope_total, count(*) FILTER ({_OK} AND NOT inside) AS out_of_scope_total, count(*) FILTER ({_ANSWERED}) AS answered_total,
        count(*) FILTER ({_ANSWERED} AND d % 9 <> 0) AS judged_total, count(*) FILTER ({_ANSWERED} AND d % 9 = 0) AS judge_failures, round(coalesce(avg(d % 11) FILTER ({_ANSWERED} AND d % 9 <> 0), 0e0), 6) AS avg_groundedness_score,
        round(coalesce(avg((d % 8) / 8e0) FILTER ({_ANSWERED} AND d % 8 <> 0), 0e0), 6) AS avg_citation_precision, round(avg(latency), 6) AS avg_latency_ms, {_share("d % 11 >= 7", _ANSWERED + " AND d % 9 <> 0")} AS groundedness_rate,
        {_share("d % 8 <> 0", _ANSWERED)} AS citation_presence, {_share("d % 8 > 2", _ANSWERED)} AS citation_validity, {_share("d % 3 = 1", _ANSWERED)} AS cites_expected_page, {_share("refused", _OK + " AND NOT inside")} AS refusal_accuracy_e2e, {_share("refused", _OK + " AND inside")} AS false_refusal_e2e
        FROM r GROUP BY preset""",
    "truncated_texts": f"SELECT conv_id, turn, {duck.truncated('t', 40)} AS text FROM (SELECT conv_id, turn, {duck.strip("coalesce(text, '')")} AS t FROM conversations)",
    "sanitized_rewrites": f"""WITH f AS (
            SELECT conv_id, turn, q, unnest(['"' || q || '"', 'Query: ' || q || chr(10) || 'lain', ' ' || chr(10) || chr(10) || '  ' || q, '  ' || chr(10) || ' ', repeat(q, 9), 'Pertanyaan mandiri - `' || q || '`']) AS raw, unnest(range(6)) AS form
            FROM (SELECT conv_id, turn, coalesce(text, '') AS q FROM conversations))
        SELECT conv_id, turn, form, {sanitized("raw", "q")} AS query FROM f""",
    "stage_totals": "SELECT doc_id, round(coalesce(n_chars, 0) / 8e0 + coalesce(n_chars, 0) / 4e0 + 5e-1, 6) AS total_ms FROM documents",
    "index_freshness": f"WITH {_FRESH} SELECT name, status FROM fr",
    "index_stale": f"WITH {_FRESH} SELECT count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status = 'untracked') AS n_untracked, count(*) FILTER (status IN ('changed', 'untracked')) > 0 AS is_stale FROM fr",
    "rate_limit": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        s AS (
            SELECT user_id, event_id, k, now AS start, CAST(1 AS BIGINT) AS used, true AS allowed, CAST(0 AS BIGINT) AS retry_after FROM e WHERE k = 1
            UNION ALL
            SELECT e.user_id, e.event_id, e.k, CASE WHEN e.now - s.start >= {WINDOW} THEN e.now ELSE s.start END,
                   CASE WHEN e.now - s.start >= {WINDOW} THEN 1 WHEN s.used >= {LIMIT} THEN s.used ELSE s.used + 1 END,
                   e.now - s.start >= {WINDOW} OR s.used < {LIMIT},
                   CASE WHEN e.now - s.start >= {WINDOW} OR s.used < {LIMIT} THEN 0 ELSE greatest(1, CAST(trunc({WINDOW} - (e.now - s.start)) AS BIGINT)) END
            FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
        SELECT user_id, event_id, allowed, used, retry_after FROM s""",
}
