"""Queries of the question pipeline: items of ``benchmark`` and user turns of ``conversations`` over ``documents``.

A document is a chunk.  Its page is taken from its id, so no window spans the
table.  Vectors stand in for embeddings: an item has the vector of its id, a user
turn one that its place in the table names; an item never finds its own vector.
Offline providers answer, and the oracles state their rules again in SQL.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


from ..functions.constants import JUDGE_CONTEXT
from ..operators import answers, evaluate, fusion, pipeline
from ..sources import providers
from ..storage import once, stored
from ..streaming import limiter
from . import duck
from .answering import NEEDS_REWRITE, sanitized
from .retrieval import CONFIG, stored_index

TALK = 1_000_000
"""Ids of user turns begin here."""
TALK_VECTORS = 500
PAGES = 997
LIMIT, WINDOW, TURN_SECONDS = 2, 3_600, 60
PRESETS = {"dense": CONFIG.with_overrides(use_hybrid=False, use_rerank=False), "hybrid": CONFIG.with_overrides(use_rerank=False), "hybrid_rerank": CONFIG}
NO_HISTORY = "cast(array() as array<struct<turn:bigint,role:string,text:string>>)"


def _table(spark: SparkSession, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark, sf) -> pipeline.Corpus:
    docs = _table(spark, sf, "documents")
    page = (F.pmod("doc_id", F.lit(PAGES)) + 1).cast("long")
    chunks = docs.select("doc_id", F.col("source").alias("source_document"), F.array(page).alias("page_numbers"), page.cast("string").alias("page_label"), F.coalesce("lang", F.lit("")).alias("section_title"), F.coalesce("text", F.lit("")).alias("text"))
    # Vectors and chunks of an index are in step.
    vectors = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(docs.select("doc_id"), "doc_id", "left_semi")
    return pipeline.Corpus(stored_index(spark, sf), vectors, chunks)


def _holding(texts, wanted):
    """``(q_id, doc_id)`` of every item and document that contains its text.  The items, a stated query set, are sent to all tasks."""
    rows = wanted.toArrow()
    sent = texts.sparkSession.sparkContext.broadcast((rows["q_id"].to_pylist(), rows["q"].to_pylist()))

    def run(batches):
        # Where an item lies in a text, its inner words are words of the text: only items whose longest one is there are looked for.
        anchored, plain = {}, []
        for q, part in zip(*sent.value):
            inner = part.split()[1:-1]
            (anchored.setdefault(max(inner, key=len), []) if inner else plain).append((q, part))
        anchors = frozenset(anchored)
        for batch in batches:
            found = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is not None:
                    near = plain + [x for w in anchors.intersection(t.split()) for x in anchored[w]]
                    found += [(q, doc) for q, part in near if part in t]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["q_id", "doc_id"])

    return texts.mapInArrow(run, "q_id long, doc_id long")


def _items(spark, sf):
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.lit("in_scope").alias("category"), F.coalesce("text", F.lit("")).alias("query"), F.expr(NO_HISTORY).alias("history"), F.lit(False).alias("has_assistant"), F.col("item_id").alias("v"))


def spoken(spark, sf):
    """``(q_id, category, query, history, has_assistant, q_vec, is_conversational)``; no document is read."""
    vectors = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("q_vec"))
    talk = answers.history_window(_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")).filter("role = 'user'")
    place = F.col("conv_id") * 100 + F.col("turn")
    turns = talk.select((TALK + place).alias("q_id"), F.lit("out_of_scope").alias("category"), F.coalesce("text", F.lit("")).alias("query"), F.col("history").cast("array<struct<turn:bigint,role:string,text:string>>").alias("history"), "has_assistant", F.pmod(place, F.lit(TALK_VECTORS)).alias("v"))
    return _items(spark, sf).unionByName(turns).join(vectors, "v").drop("v").withColumn("is_conversational", F.size("history") > 0)


def questions(spark, sf):
    """``spoken`` with ``expected_pages`` and ``expected_keywords``."""
    # Ground truth of an item: pages of the documents that contain its text; its first words are expected in the contexts.
    texts = _table(spark, sf, "documents").select("doc_id", F.lower("text").cast("binary").alias("t"))
    wanted = _items(spark, sf).filter("query <> ''").select("q_id", F.lower("query").cast("binary").alias("q"))
    held = _holding(texts, wanted).groupBy("q_id").agg(F.array_sort(F.collect_set((F.pmod("doc_id", F.lit(PAGES)) + 1).cast("long"))).alias("expected_pages"))
    words = F.when(F.col("category") == "in_scope", F.slice(F.filter(F.split("query", "\\s+"), lambda w: w != ""), 1, 3)).otherwise(F.array().cast("array<string>"))
    return spoken(spark, sf).join(held, "q_id", "left").withColumns({"expected_pages": F.coalesce("expected_pages", F.array().cast("array<long>")), "expected_keywords": words})


def _asked(spark, sf):
    return once(spark, sf, "asked", lambda: stored(questions(spark, sf), "asked"))


def outcome(spark, sf, preset: str = "hybrid_rerank") -> pipeline.Outcome:
    """The pipeline's result for one preset, computed once an application."""

    def build():
        searched = once(spark, sf, "searched", lambda: pipeline.search(_asked(spark, sf), corpus(spark, sf), CONFIG, providers.OfflineRewriter()))
        return pipeline.retrieve(_asked(spark, sf), corpus(spark, sf), PRESETS[preset], reranker=providers.OfflineReranker(), searched=searched)

    return once(spark, sf, f"outcome-{preset}", build)


def _generated(spark, sf):
    return once(spark, sf, "generated", lambda: stored(pipeline.generate(_asked(spark, sf), outcome(spark, sf), providers.OfflineAnswerer()), "generated"))


def _text(pages: Column) -> Column:
    return F.array_join(pages.cast("array<string>"), ",")


def rewritten_queries(spark, sf):
    """Every question as it is searched; nothing is searched for it."""
    rows = pipeline.rewrite_queries(stored(spoken(spark, sf), "spoken"), providers.OfflineRewriter(), CONFIG)
    return rows.select("q_id", "effective_query", "was_rewritten")


def _prompt(df):
    """Digest and length of each prompt."""
    return df.select("q_id", F.md5(F.col("prompt").cast("binary")).alias("digest"), F.length("prompt").cast("long").alias("n_chars"))


def rewrite_prompts(spark, sf):
    rows = _asked(spark, sf).filter("is_conversational")
    return _prompt(rows.select("q_id", answers.history_prompt(F.col("history"), F.col("query")).alias("prompt")))


def rerank_prompts(spark, sf):
    found = outcome(spark, sf)
    return _prompt(answers.rerank_prompts(found.candidates.join(found.verdicts.select("q_id", F.col("effective_query").alias("query")), "q_id")))


def answer_prompts(spark, sf):
    found = outcome(spark, sf)
    contexts = found.contexts.join(found.verdicts.select("q_id", "query"), "q_id").withColumn("document_label", F.col("source_document"))
    return _prompt(answers.answer_prompts(contexts, histories=_asked(spark, sf).select("q_id", "history")))


def judge_prompts(spark, sf):
    return _prompt(answers.judge_prompts(outcome(spark, sf).contexts, _generated(spark, sf)))


def selected_questions(spark, sf):
    """The first twenty conversational questions."""
    return evaluate.select_questions(_asked(spark, sf), "out_of_scope", 20, True).select("q_id", "category", "query")


def retrieve(spark, sf):
    v = outcome(spark, sf).verdicts
    return v.select("q_id", "n_candidates", "max_dense_score", "max_lexical_coverage", "dense_pass", "lexical_pass", "rerank_pass", "rerank_failed", "refused", "refusal_reason")


def final_contexts(spark, sf):
    return outcome(spark, sf).contexts.select("q_id", F.col("final_rank"), "doc_id", "source_document", "page_label", "fusion_rank", "rerank_score", "rerank_ok")


def debug_candidates(spark, sf):
    return pipeline.debug_candidates(outcome(spark, sf))


def generated_answers(spark, sf):
    g = _generated(spark, sf)
    return g.select("q_id", "refused", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("generation_error", F.lit("")).alias("generation_error"), _text(F.col("context_pages")).alias("context_pages"))


def guarded_answers(spark, sf):
    g = pipeline.guard(_generated(spark, sf))
    return g.select("q_id", "diagnosis", "display", _text(F.col("cited_pages")).alias("cited_pages"))


def cited_source_cards(spark, sf):
    cards = pipeline.cited_cards(outcome(spark, sf), pipeline.guard(_generated(spark, sf)))
    return cards.select("q_id", "card_no", "source_document", _text(F.col("pages")).alias("pages"), "section_title", "score")


def source_cards(spark, sf):
    """Cards of all contexts, before any answer."""
    rows = outcome(spark, sf).contexts.withColumn("score", fusion.display_score(F.col("rerank_score"), F.col("dense_score")))
    return answers.source_cards(rows).select("q_id", "card_no", "source_document", _text(F.col("pages")).alias("pages"), "section_title", "score")


def chat_turns(spark, sf):
    """Every user turn, under a limit of questions a conversation."""
    asked = _asked(spark, sf).filter(F.col("q_id") >= TALK)
    place = F.col("q_id") - TALK
    events = asked.select(F.floor(place / 100).alias("user_id"), F.col("q_id").alias("event_id"), F.timestamp_seconds(F.pmod(place, F.lit(100)) * TURN_SECONDS).alias("ts"))
    limits = limiter.rate_limit(events, LIMIT, WINDOW).select(F.col("event_id").alias("q_id"), "allowed", "retry_after")
    found = outcome(spark, sf)
    talk = pipeline.Outcome(*(x.filter(F.col("q_id") >= TALK) for x in (found.verdicts, found.candidates, found.contexts)))
    out = pipeline.chat_turns(asked, talk, providers.OfflineAnswerer(), stored(limits, "limits"))
    return out.select("q_id", "status", "display", "diagnosis", _text(F.col("cited_pages")).alias("cited_pages"), "n_cards")


def score_questions(spark, sf):
    rows = evaluate.score_questions(_asked(spark, sf), outcome(spark, sf))
    return rows.select(
        "q_id", "category", "is_conversational", "has_expected_pages", _text(F.col("retrieved_pages")).alias("retrieved_pages"), "page_hit", F.coalesce("first_relevant_rank", F.lit(0)).cast("long").alias("first_relevant_rank"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"),
        "has_keywords", F.size("missing_keywords").cast("long").alias("n_missing"), "keyword_hit", "refused", "rerank_failed", "top_dense_score",
    )


def _scored(spark, sf):
    """All presets over all questions; a set has no latency of a single question, so it counts as 0."""

    def build():
        parts = {name: evaluate.score_questions(_asked(spark, sf), outcome(spark, sf, name)) for name in PRESETS}
        return stored(evaluate.run_presets(parts, lambda rows: rows).withColumn("latency_ms", F.lit(0.0)), "scored")

    return once(spark, sf, "scored", build)


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def evaluate_presets(spark, sf):
    return _rounded(evaluate.retrieval_metrics(_scored(spark, sf)).drop("avg_latency_ms", "median_latency_ms"))


def preset_comparison(spark, sf):
    return _rounded(evaluate.compare(evaluate.retrieval_metrics(_scored(spark, sf)).drop("avg_latency_ms", "median_latency_ms")))


def _judged(spark, sf):
    return once(spark, sf, "judged", lambda: stored(evaluate.score_answers(_asked(spark, sf), outcome(spark, sf), _generated(spark, sf), providers.OfflineJudge()), "judged"))


def score_answers(spark, sf):
    rows = _judged(spark, sf)
    return rows.select("q_id", "refused_by_retrieval", "refused_in_answer", "generation_failed", _text(F.col("cited_pages")).alias("cited_pages"), "has_citation", "citation_valid", F.round("citation_precision", 6).alias("citation_precision"), "cites_expected_page", F.coalesce("groundedness_score", F.lit(-1.0)).alias("groundedness_score"), "grounded", "judge_failed")


def evaluate_answers(spark, sf):
    rows = _judged(spark, sf).withColumns({"preset": F.lit("hybrid_rerank"), "latency_ms": F.lit(0.0)})
    return _rounded(evaluate.answer_metrics(rows).drop("avg_latency_ms"))


QUERIES = {f.__name__: f for f in (rewritten_queries, rewrite_prompts, rerank_prompts, answer_prompts, judge_prompts, selected_questions, retrieve, final_contexts, debug_candidates, generated_answers, guarded_answers, source_cards, cited_source_cards, chat_turns, score_questions, evaluate_presets, preset_comparison, score_answers, evaluate_answers)}

# ---- The same rules in SQL --------------------------------------------------

_T = f"(1e0 * {CONFIG.dense_threshold})"
_LAST_USER = "list_filter(users, lambda u: u IS NOT NULL)[-1]"
_REPLY = f"coalesce(string_split({duck.truncated(duck.strip(_LAST_USER), 400)}, chr(10))[1], '') || ' ' || q"
_QS = f"""tk AS (
            SELECT conv_id * 100 + turn AS place, role, coalesce(text, '') AS q, count(*) OVER w AS n_hist, list(CASE WHEN role = 'user' THEN coalesce(text, '') END) OVER w AS users, list({{'r': role, 't': text}}) OVER w AS msgs,
                   coalesce(bool_or(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS h
            FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
        rw AS (SELECT *, CASE WHEN n_hist > 0 AND {NEEDS_REWRITE} THEN {sanitized(_REPLY, "q")} ELSE q END AS eff FROM tk WHERE role = 'user'),
        qs AS (
            SELECT q_id, category, q, eff, coalesce({duck.strip('eff')} <> {duck.strip('q')}, false) AS was_rewritten, talk, v FROM (
                SELECT item_id AS q_id, 'in_scope' AS category, coalesce(text, '') AS q, coalesce(text, '') AS eff, false AS talk, item_id AS v FROM benchmark
                UNION ALL SELECT {TALK} + place, 'out_of_scope', q, eff, n_hist > 0, place % {TALK_VECTORS} FROM rw)
            JOIN (SELECT vec_id FROM embeddings) e ON e.vec_id = v),
        qt AS (SELECT q_id, eff AS text FROM qs)"""
_SEARCH = f"""{_QS}, {duck.bm25("qt", "q_id")},
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS lexical_rank FROM hits) WHERE lexical_rank <= 20),
        ds AS (SELECT qs.q_id, b.vec_id AS doc_id, {duck.UNIT_DOT} AS dense_score FROM qs JOIN embeddings a ON a.vec_id = qs.v JOIN embeddings b ON b.vec_id <> qs.q_id SEMI JOIN documents t ON t.doc_id = b.vec_id),
        d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dense_score DESC, doc_id) AS dense_rank FROM ds) WHERE dense_rank <= 20),
        doc AS (SELECT doc_id, source, coalesce(lang, '') AS lang, coalesce(text, '') AS body, doc_id % {PAGES} + 1 AS page FROM documents)"""


def _outcome(hybrid: bool = True, rerank: bool = True, s: str = "") -> str:
    """CTEs from the candidates to the verdicts and contexts of one preset, named with the suffix ``s``."""
    fused = f"""SELECT coalesce(d.q_id, l.q_id) AS q_id, coalesce(d.doc_id, l.doc_id) AS doc_id, dense_score, dense_rank, lexical_rank, score, coverage, matched_terms,
                   round(coalesce(1e0 / (60 + dense_rank), 0) + coalesce(1e0 / (60 + lexical_rank), 0), 9) AS fusion_score
            FROM d FULL JOIN {"l" if hybrid else "(SELECT * FROM l WHERE false) l"} ON d.q_id = l.q_id AND d.doc_id = l.doc_id"""
    ok = "n = 1 OR nw % 11 <> 0" if rerank else "true"
    score = f"CASE WHEN n > 1 AND ({ok}) THEN (1000 * held // greatest(1, len(asked))) / 1e2 END" if rerank else "CAST(NULL AS DOUBLE)"
    passed = "CASE WHEN bool_and(ok) AND count(*) > 1 THEN bool_or(coalesce(rs, 0) >= 4) END" if rerank else "CAST(NULL AS BOOLEAN)"
    snippet = duck.truncated(duck.strip(f"regexp_replace(body, '{duck.SPACE}+', ' ', 'g')"), 900)
    return f"""fu{s} AS ({fused}),
        cand{s} AS (
            SELECT r.q_id, r.doc_id, fusion_score, fusion_rank, dense_rank, lexical_rank, r.score, r.matched_terms, source, lang, body, page,
                   coalesce(r.dense_score, CASE WHEN b.vec_id IS NULL THEN 0e0 ELSE {duck.UNIT_DOT} END) AS dense_score, coalesce(r.coverage, h.coverage, 0e0) AS coverage
            FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY fusion_score DESC, coalesce(dense_score, 0e0) DESC, dense_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST, doc_id) AS fusion_rank FROM fu{s}) r
            JOIN qs ON qs.q_id = r.q_id LEFT JOIN embeddings a ON a.vec_id = qs.v LEFT JOIN embeddings b ON b.vec_id = r.doc_id LEFT JOIN hits h ON h.q_id = r.q_id AND h.doc_id = r.doc_id JOIN doc ON doc.doc_id = r.doc_id
            WHERE fusion_rank <= 10),
        gt{s} AS (
            SELECT qs.q_id, count(c.doc_id) AS n, coalesce(max(dense_score), 0e0) AS top_dense, coalesce(max(coverage), 0e0) AS top_coverage,
                   coalesce(bool_or(coverage >= 6e-1 AND coalesce(len(matched_terms), 0) >= 2 AND dense_score >= 7e-1 * {_T}), false) AS lexical_pass
            FROM qs LEFT JOIN cand{s} c ON c.q_id = qs.q_id GROUP BY qs.q_id),
        gate{s} AS (SELECT *, n > 0 AND top_dense >= {_T} AS dense_pass, (n > 0 AND top_dense >= {_T}) OR lexical_pass AS passed FROM gt{s}),
        sn{s} AS (
            SELECT c.*, g.n, len({duck.words("eff")}) AS nw, list_distinct({duck.words("eff")}) AS asked, len(list_intersect(list_distinct({duck.words("eff")}), {duck.words(snippet)})) AS held
            FROM cand{s} c JOIN gate{s} g ON g.q_id = c.q_id AND g.passed JOIN qs ON qs.q_id = c.q_id),
        rr{s} AS (SELECT *, {ok} AS ok, {score} AS rs FROM sn{s}),
        rg{s} AS (SELECT q_id, {passed} AS rerank_pass, NOT bool_and(ok) AS rerank_failed FROM rr{s} GROUP BY q_id),
        ctx{s} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rs DESC NULLS LAST, fusion_rank) AS final_rank FROM rr{s} WHERE NOT ok OR (rs IS NULL AND {"n = 1" if rerank else "true"}) OR coalesce(rs, 0) >= 4) WHERE final_rank <= 4),
        vd{s} AS (
            SELECT qs.q_id, q, eff, was_rewritten, g.n, top_dense, top_coverage, dense_pass, lexical_pass, rerank_pass, coalesce(rerank_failed, false) AS rerank_failed, NOT passed OR coalesce(NOT rerank_pass, false) AS refused,
                   CASE WHEN g.n = 0 THEN 'no_candidates' WHEN NOT passed THEN 'below_relevance_gate' WHEN coalesce(NOT rerank_pass, false) THEN 'below_rerank_threshold' ELSE '' END AS reason
            FROM qs JOIN gate{s} g ON g.q_id = qs.q_id LEFT JOIN rg{s} ON rg{s}.q_id = qs.q_id)"""


_OUTCOME = f"{_SEARCH}, {_outcome()}"
_PROMPT = "SELECT q_id, md5(prompt) AS digest, length(prompt) AS n_chars FROM pr"
_SAID = f"sd AS (SELECT place, q, list_filter(list_transform(msgs, lambda m: CASE WHEN m.r = 'user' THEN 'Pengguna: ' ELSE 'Asisten: ' END || {duck.truncated(duck.strip('m.t'), 400)}), lambda x: x IS NOT NULL) AS said FROM tk WHERE role = 'user' AND n_hist > 0)"
_JOINED = "array_to_string({}, ',')"
_MARK = " OR ".join(f"contains(lower(answer), '{m}')" for m in answers.ERROR_MARKS)
_CODES = " ".join(f"WHEN ({_MARK}) AND ({' OR '.join(f"contains(lower(answer), '{w}')" for w in ws)}) THEN '{code}'" for code, ws in answers.ERROR_CODES)
_GENERATED = f"""{_OUTCOME},
        gen AS (
            SELECT v.q_id, v.q, v.refused, len({duck.words("v.q")}) AS nq, c.page, array_to_string(list_filter(string_split_regex(c.body, '{duck.SPACE}+'), lambda w: w <> '')[1:8], ' ') AS quote,
                   coalesce((SELECT list_sort(list(DISTINCT CAST(x.page AS INT))) FROM ctx x WHERE x.q_id = v.q_id AND NOT v.refused), []::INT[]) AS context_pages
            FROM vd v LEFT JOIN ctx c ON c.q_id = v.q_id AND c.final_rank = 1),
        ans AS (
            SELECT q_id, q, refused, context_pages, CASE WHEN refused THEN '{answers.no_context_answer()}' WHEN nq % 13 = 0 THEN NULL WHEN nq % 5 = 0 THEN quote
                   ELSE quote || ' (Halaman ' || (page + CASE WHEN nq % 7 = 0 THEN 5000 ELSE 0 END) || ').' || chr(10) || 'Sumber: Halaman ' || page END AS answer,
                   CASE WHEN NOT refused AND nq % 13 = 0 THEN 'HTTP 500: upstream' ELSE '' END AS error FROM gen)"""
_GUARDED = f"""{_GENERATED},
        dg AS (
            SELECT *, CASE WHEN refused THEN '' WHEN {duck.strip("coalesce(answer, '')")} = '' THEN 'empty_response' {_CODES} WHEN {_MARK} THEN 'provider_error'
                   WHEN NOT regexp_matches(answer, '(?i)\\bhalaman\\s*:?\\s*\\d{{1,4}}\\b') THEN 'missing_page_citation' WHEN len(list_filter({duck.cited("answer")}, lambda p: NOT list_contains(context_pages, p))) > 0 THEN 'citation_outside_context' ELSE '' END AS diagnosis
            FROM ans),
        sh AS (SELECT *, CASE WHEN diagnosis <> '' THEN '{answers.unverified_answer()}' ELSE answer END AS shown FROM dg),
        gd AS (
            SELECT *, {duck.cited("shown")} AS cites,
                   {duck.strip("regexp_replace(array_to_string(list_filter(string_split_regex(shown, '\\r\\n|\\r|\\n'), lambda x: NOT (contains(lower(x), 'sumber:') AND contains(lower(x), 'halaman'))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} AS display
            FROM sh),
        cd AS (
            SELECT c.q_id, c.source, c.final_rank, lang, coalesce(rs / 10, dense_score) AS score, CASE WHEN len(cites) = 0 OR list_contains(cites, CAST(page AS INT)) THEN page END AS page
            FROM ctx c JOIN gd ON gd.q_id = c.q_id AND NOT gd.refused WHERE len(cites) = 0 OR list_contains(cites, CAST(page AS INT))),
        card AS (
            SELECT q_id, source, list_sort(list(DISTINCT page)) AS pages, arg_max(lang, struct_pack(s := score, r := -final_rank)) AS section_title, round(max(score), 4) AS score, row_number() OVER (PARTITION BY q_id ORDER BY min(final_rank)) AS card_no
            FROM cd GROUP BY q_id, source)"""
_EXPECTED = f"""ex AS (
            SELECT b.item_id AS q_id, list_sort(list(DISTINCT doc_id % {PAGES} + 1)) AS pages FROM benchmark b JOIN documents t ON b.text <> '' AND contains(lower(t.text), lower(b.text)) GROUP BY ALL),
        kw AS (SELECT qs.*, CASE WHEN category = 'in_scope' THEN list_filter(string_split_regex(q, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')[1:3] ELSE [] END AS kws, coalesce(pages, []) AS expected FROM qs LEFT JOIN ex USING (q_id))"""


def _scored_sql(s: str = "") -> str:
    """A CTE ``sq`` of the scored questions of the preset with the suffix ``s``."""
    return f"""hl{s} AS (
            SELECT q_id, list_sort(list(DISTINCT page)) AS got, string_agg(lower(body), ' ' ORDER BY final_rank) AS txt, list(page ORDER BY final_rank) AS pgs FROM ctx{s} GROUP BY q_id),
        sq{s} AS (
            SELECT k.q_id, category, talk, len(expected) > 0 AS has_pages, coalesce(got, []) AS got, list_min(list_filter(range(1, coalesce(len(pgs), 0) + 1), lambda i: list_contains(expected, pgs[i]))) AS first_rank,
                   len(kws) > 0 AS has_kw, len(list_filter(kws, lambda w: NOT contains(coalesce(txt, ''), lower(w)))) AS n_missing, refused, rerank_failed, round(top_dense, 4) AS top_dense
            FROM kw k JOIN vd{s} v ON v.q_id = k.q_id LEFT JOIN hl{s} h ON h.q_id = k.q_id)"""


def _share(a: str, b: str) -> str:
    return f"round(CASE WHEN count(*) FILTER ({b}) > 0 THEN count(*) FILTER (({a}) AND ({b})) / count(*) FILTER ({b})::DOUBLE ELSE 0e0 END, 6)"


_SUFFIX = {"dense": ("_d", False, False), "hybrid": ("_h", True, False), "hybrid_rerank": ("", True, True)}
_IN, _OUT, _HIT, _KW = "category = 'in_scope'", "category = 'out_of_scope'", "first_rank IS NOT NULL", "has_kw AND n_missing = 0"
_METRICS = {
    "rerank_failures": "count(*) FILTER (rerank_failed)", "page_recall_hits": f"count(*) FILTER ({_IN} AND has_pages AND {_HIT})", "page_recall_total": f"count(*) FILTER ({_IN} AND has_pages)",
    "mrr": f"round(coalesce(avg(coalesce(1e0 / first_rank, 0e0)) FILTER ({_IN} AND has_pages), 0e0), 6)", "keyword_hits": f"count(*) FILTER ({_IN} AND {_KW})", "keyword_total": f"count(*) FILTER ({_IN} AND has_kw)",
    "correct_refusals": f"count(*) FILTER ({_OUT} AND refused)", "out_of_scope_total": f"count(*) FILTER ({_OUT})", "false_refusals": f"count(*) FILTER ({_IN} AND refused)", "in_scope_total": f"count(*) FILTER ({_IN})",
    "conversational_hits": f"count(*) FILTER ({_IN} AND talk AND {_HIT})", "conversational_total": f"count(*) FILTER ({_IN} AND talk)", "page_recall": _share(_HIT, f"{_IN} AND has_pages"), "keyword_coverage": _share(_KW, f"{_IN} AND has_kw"),
    "refusal_accuracy": _share("refused", _OUT), "false_refusal_rate": _share("refused", _IN), "conversational_recall": _share(_HIT, f"{_IN} AND talk"),
}
_ALL = f"""{_SEARCH}, {", ".join(_outcome(h, r, s) for s, h, r in _SUFFIX.values())}, {_EXPECTED}, {", ".join(_scored_sql(s) for s, _, _ in _SUFFIX.values())},
        every AS ({" UNION ALL ".join(f"SELECT '{n}' AS preset, * FROM sq{s}" for n, (s, _, _) in _SUFFIX.items())}),
        mt AS (SELECT preset, {", ".join(f"{x} AS {n}" for n, x in _METRICS.items())} FROM every GROUP BY preset)"""
_JUDGED = f"""{_GENERATED}, {_EXPECTED},
        src AS (SELECT q_id, list_distinct(flatten(list({duck.words(duck.truncated(duck.strip("body"), JUDGE_CONTEXT))}))) AS ws, list_distinct(flatten(list([lower('[Sumber'), CAST(final_rank AS VARCHAR), '|', 'halaman', page || ']']))) AS heads FROM ctx GROUP BY q_id),
        cc AS (SELECT a.*, error <> '' AS failed, coalesce(expected, []) AS expected, category, CASE WHEN refused OR error <> '' THEN []::INT[] ELSE {duck.cited("answer")} END AS cites FROM ans a JOIN kw ON kw.q_id = a.q_id),
        ju AS (
            SELECT cc.*, NOT refused AND NOT failed AND ({" OR ".join(f"contains(lower(answer), '{p}')" for p in answers.REFUSALS)}) AS declined, NOT refused AND NOT failed AND coalesce(answer, '') <> '' AS judged, {duck.words("coalesce(answer, '')")} AS aw, list_concat(ws, heads) AS ws
            FROM cc LEFT JOIN src ON src.q_id = cc.q_id),
        jd AS (
            SELECT *, len(list_filter(cites, lambda p: NOT list_contains(context_pages, p))) AS n_bad, judged AND NOT declined AND len(aw) % 6 = 0 AS judge_failed,
                   CASE WHEN judged AND NOT declined AND len(aw) % 6 <> 0 THEN CAST(10 * len(list_intersect(list_distinct(aw), ws)) // greatest(1, len(list_distinct(aw))) AS DOUBLE) END AS score
            FROM ju),
        an AS (
            SELECT q_id, category, refused, declined, failed, cites, len(cites) > 0 AS has_citation, len(cites) > 0 AND n_bad = 0 AS valid, CASE WHEN len(cites) > 0 THEN (len(cites) - n_bad) / len(cites)::DOUBLE ELSE 0e0 END AS prec,
                   list_has_any(cites, list_transform(expected, lambda x: CAST(x AS INT))) AS expects, score, coalesce(score >= 7, false) AS grounded, judge_failed FROM jd)"""
_OKAY = "NOT failed"
_ANSWERED = f"{_OKAY} AND {_IN} AND NOT (refused OR declined)"
_JUDGEABLE = f"{_ANSWERED} AND NOT judge_failed AND score IS NOT NULL"

ORACLE_SQL = {
    "rewritten_queries": f"WITH {_QS} SELECT q_id, eff AS effective_query, was_rewritten FROM qs",
    "rewrite_prompts": f"WITH {_QS}, {_SAID}, pr AS (SELECT {TALK} + place AS q_id, 'Riwayat percakapan:' || chr(10) || array_to_string(said, chr(10)) || chr(10) || chr(10) || 'Pertanyaan terakhir: ' || q AS prompt FROM sd) {_PROMPT}",
    "rerank_prompts": f"""WITH {_OUTCOME}, pr AS (
            SELECT c.q_id, 'Pertanyaan: ' || any_value(eff) || chr(10) || chr(10) || 'Kandidat:' || chr(10) || string_agg('[' || fusion_rank || '] ' || {duck.truncated(duck.strip(f"regexp_replace(body, '{duck.SPACE}+', ' ', 'g')"), 900)}, chr(10) || chr(10) ORDER BY fusion_rank) AS prompt
            FROM cand c JOIN qs ON qs.q_id = c.q_id GROUP BY c.q_id HAVING count(*) > 1) {_PROMPT}""",
    "answer_prompts": f"""WITH {_OUTCOME}, {_SAID.replace(duck.truncated(duck.strip("m.t"), 400), "coalesce(m.t, '')")}, s AS (SELECT *, source || ', Halaman ' || page || CASE WHEN lang <> '' THEN ', ' || lang ELSE '' END AS src FROM ctx),
        b AS (SELECT q_id, string_agg('[Konteks ' || final_rank || ' | ' || src || ']' || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY final_rank) AS blocks, list(src ORDER BY final_rank) AS ss FROM s GROUP BY q_id),
        pr AS (
            SELECT b.q_id, 'Konteks:' || chr(10) || blocks || CASE WHEN len(said) > 0 THEN chr(10) || chr(10) || 'Riwayat percakapan terkini:' || chr(10) || array_to_string(said, chr(10)) ELSE '' END || chr(10) || chr(10) || 'Pertanyaan: ' || qs.q || chr(10) || chr(10)
                   || 'Sitasi yang boleh dipakai:' || chr(10) || array_to_string(list_transform(list_filter(ss, lambda x, i: list_position(ss, x) = i), lambda x: '- ' || x), chr(10)) AS prompt
            FROM b JOIN qs ON qs.q_id = b.q_id LEFT JOIN sd ON {TALK} + sd.place = b.q_id) {_PROMPT}""",
    "judge_prompts": f"""WITH {_GENERATED}, b AS (
            SELECT q_id, string_agg('[Sumber ' || final_rank || ' | Halaman ' || page || ']' || chr(10) || {duck.truncated(duck.strip("body"), JUDGE_CONTEXT)}, chr(10) || chr(10) ORDER BY final_rank) AS blocks FROM ctx GROUP BY q_id),
        pr AS (SELECT q_id, 'Pertanyaan: ' || q || chr(10) || chr(10) || 'Sumber:' || chr(10) || blocks || chr(10) || chr(10) || 'Jawaban yang dinilai:' || chr(10) || answer || chr(10) || chr(10) || 'Balas hanya dengan JSON.' AS prompt FROM ans JOIN b USING (q_id) WHERE coalesce(answer, '') <> '') {_PROMPT}""",
    "selected_questions": f"WITH {_QS} SELECT q_id, category, q AS query FROM qs WHERE category = 'out_of_scope' AND talk ORDER BY q_id LIMIT 20",
    "retrieve": f"WITH {_OUTCOME} SELECT q_id, n AS n_candidates, top_dense AS max_dense_score, top_coverage AS max_lexical_coverage, dense_pass, lexical_pass, rerank_pass, rerank_failed, refused, reason AS refusal_reason FROM vd",
    "final_contexts": f"WITH {_OUTCOME} SELECT q_id, final_rank, doc_id, source AS source_document, CAST(page AS VARCHAR) AS page_label, fusion_rank, rs AS rerank_score, ok AS rerank_ok FROM ctx",
    "debug_candidates": f"""WITH {_OUTCOME}
        SELECT c.q_id, c.doc_id, x.doc_id IS NOT NULL AS used, c.source AS source_document, CAST(c.page AS VARCHAR) AS page_label, CASE WHEN c.lang = '' THEN '-' ELSE c.lang END AS section,
               CASE WHEN c.dense_rank IS NOT NULL AND c.lexical_rank IS NOT NULL THEN 'dense+bm25' WHEN c.dense_rank IS NOT NULL THEN 'dense' ELSE 'bm25' END AS retrieved_by, round(c.dense_score, 3) AS dense, round(coalesce(c.score, 0e0), 2) AS bm25,
               round(c.fusion_score, 5) AS rrf, round(r.rs, 1) AS rerank, CAST(round(c.coverage * 100) AS INT) || '%' AS term_coverage, CASE WHEN coalesce(len(c.matched_terms), 0) > 0 THEN array_to_string(c.matched_terms, ', ') ELSE '-' END AS terms
        FROM cand c LEFT JOIN rr r ON r.q_id = c.q_id AND r.doc_id = c.doc_id LEFT JOIN ctx x ON x.q_id = c.q_id AND x.doc_id = c.doc_id""",
    "generated_answers": f"WITH {_GENERATED} SELECT q_id, refused, coalesce(answer, '') AS answer, error AS generation_error, {_JOINED.format('context_pages')} AS context_pages FROM ans",
    "guarded_answers": f"WITH {_GUARDED} SELECT q_id, diagnosis, display, {_JOINED.format('cites')} AS cited_pages FROM gd",
    "source_cards": f"""WITH {_OUTCOME}
        SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY min(final_rank)) AS card_no, source AS source_document, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages,
               arg_max(lang, struct_pack(s := coalesce(rs / 10, dense_score), r := -final_rank)) AS section_title, round(max(coalesce(rs / 10, dense_score)), 4) AS score FROM ctx GROUP BY q_id, source""",
    "cited_source_cards": f"WITH {_GUARDED} SELECT q_id, card_no, source AS source_document, {_JOINED.format('pages')} AS pages, section_title, score FROM card",
    "chat_turns": f"""WITH {_GUARDED},
        nc AS (SELECT q_id, count(*) AS n FROM card GROUP BY q_id),
        ev AS (SELECT gd.*, floor((q_id - {TALK}) / 100) AS conv, (q_id - {TALK}) % 100 AS turn FROM gd WHERE q_id >= {TALK}),
        lm AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn) > {LIMIT} AS denied FROM ev)
        SELECT lm.q_id, CASE WHEN denied THEN 'rate_limited' WHEN refused THEN 'refused' WHEN diagnosis <> '' THEN 'unverified' ELSE 'answered' END AS status, CASE WHEN denied THEN '' ELSE display END AS display,
               CASE WHEN denied THEN '' ELSE diagnosis END AS diagnosis, CASE WHEN denied THEN '' ELSE {_JOINED.format('cites')} END AS cited_pages, CASE WHEN denied OR refused THEN 0 ELSE coalesce(n, 0) END AS n_cards
        FROM lm LEFT JOIN nc ON nc.q_id = lm.q_id""",
    "score_questions": f"""WITH {_OUTCOME}, {_EXPECTED}, {_scored_sql()}
        SELECT q_id, category, talk AS is_conversational, has_pages AS has_expected_pages, {_JOINED.format('got')} AS retrieved_pages, {_HIT} AS page_hit, coalesce(first_rank, 0) AS first_relevant_rank, round(coalesce(1e0 / first_rank, 0e0), 6) AS reciprocal_rank,
               has_kw AS has_keywords, n_missing, {_KW} AS keyword_hit, refused, rerank_failed, top_dense AS top_dense_score FROM sq""",
    "evaluate_presets": f"WITH {_ALL} SELECT * FROM mt",
    "preset_comparison": f"""WITH {_ALL}, long AS ({" UNION ALL ".join(f"SELECT preset, '{n}' AS metric, CAST({n} AS DOUBLE) AS v FROM mt" for n in _METRICS)})
        SELECT metric, {", ".join(f"max(v) FILTER (preset = '{n}') AS {n}" for n in _SUFFIX)} FROM long GROUP BY metric""",
    "score_answers": f"WITH {_JUDGED} SELECT q_id, refused AS refused_by_retrieval, declined AS refused_in_answer, failed AS generation_failed, {_JOINED.format('cites')} AS cited_pages, has_citation, valid AS citation_valid, round(prec, 6) AS citation_precision, expects AS cites_expected_page, coalesce(score, -1e0) AS groundedness_score, grounded, judge_failed FROM an",
    "evaluate_answers": f"""WITH {_JUDGED} SELECT 'hybrid_rerank' AS preset, count(*) AS total, count(*) FILTER (failed) AS generation_failures, count(*) FILTER ({_OKAY} AND {_IN}) AS in_scope_total, count(*) FILTER ({_OKAY} AND {_OUT}) AS out_of_scope_total, count(*) FILTER ({_ANSWERED}) AS answered_total,
        count(*) FILTER ({_JUDGEABLE}) AS judged_total, count(*) FILTER ({_ANSWERED} AND judge_failed) AS judge_failures, round(coalesce(avg(score) FILTER ({_JUDGEABLE}), 0e0), 6) AS avg_groundedness_score, round(coalesce(avg(prec) FILTER ({_ANSWERED} AND has_citation), 0e0), 6) AS avg_citation_precision,
        {_share("grounded", _JUDGEABLE)} AS groundedness_rate, {_share("has_citation", _ANSWERED)} AS citation_presence, {_share("valid", _ANSWERED)} AS citation_validity, {_share("expects", _ANSWERED)} AS cites_expected_page,
        {_share("refused OR declined", f"{_OKAY} AND {_OUT}")} AS refusal_accuracy_e2e, {_share("refused OR declined", f"{_OKAY} AND {_IN}")} AS false_refusal_e2e FROM an""",
}
