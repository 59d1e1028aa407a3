"""The question pipeline, set at a time: rewrite, search, fuse, gate, rerank, contexts, answer, guard.

Every stage is a DataFrame of questions or of their candidates; an early return
of a single question is a column here.  Replies of providers and the candidates
are written, so a lost task never asks a provider again for what is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import RetrievalConfig
from ..functions.text import strip
from ..sources.providers import Chat, complete
from ..storage import stored
from . import answers, dense, fusion, lexical

# Reasons for which a question is refused before an answer is generated.
NO_CANDIDATES, BELOW_GATE, BELOW_RERANK = "no_candidates", "below_relevance_gate", "below_rerank_threshold"


@dataclass(frozen=True)
class Corpus:
    """What is searched: ``chunks(doc_id, source_document, page_numbers, page_label, section_title, text)`` and its indexes."""

    index: lexical.LexicalIndex
    vectors: DataFrame  # doc_id, embedding
    chunks: DataFrame


@dataclass(frozen=True)
class Searched:
    """Questions as they are searched, and the lists found: ``near(q_id, doc_id, dense_score, dense_rank)``, ``found(q_id, doc_id, score, lexical_rank)`` or None."""

    asked: DataFrame
    near: DataFrame
    found: DataFrame | None


@dataclass(frozen=True)
class Outcome:
    """``verdicts`` has a row for each question, ``candidates`` all fused ones, ``contexts`` those an answer may use."""

    verdicts: DataFrame
    candidates: DataFrame
    contexts: DataFrame


def rewrite_queries(questions: DataFrame, provider: Chat | None, cfg: RetrievalConfig) -> DataFrame:
    """``questions(q_id, query, history, has_assistant, …)`` with ``effective_query`` and ``was_rewritten``.

    Only questions that need their history reach the provider; a failed or
    useless reply leaves the question as it is.
    """
    if provider is None or not cfg.use_query_rewrite:
        return questions.withColumns({"effective_query": F.col("query"), "was_rewritten": F.lit(False)})
    asked = questions.filter((F.size("history") > 0) & answers.needs_rewrite(F.col("query"), F.col("has_assistant")))
    prompts = asked.select("q_id", answers.history_prompt(F.col("history"), F.col("query")).alias("prompt"))
    replies = stored(complete(prompts, "prompt", provider).select("q_id", "reply"), "rewrites")
    joined = questions.join(replies, "q_id", "left")
    text = F.when(F.col("reply").isNull(), F.col("query")).otherwise(answers.sanitize_rewrite(F.col("reply"), F.col("query")))
    joined = joined.withColumn("effective_query", text).drop("reply")
    return joined.withColumn("was_rewritten", F.coalesce(strip(F.col("effective_query")) != strip(F.col("query")), F.lit(False)))


def search(questions: DataFrame, corpus: Corpus, cfg: RetrievalConfig, rewriter: Chat | None = None) -> Searched:
    """Rewritten questions and both ranked lists, written: presets that differ only in what follows share them.

    A document filter restricts both searches before they rank; statistics of the corpus stay global.
    """
    asked = stored(rewrite_queries(questions, rewriter, cfg), "questions")
    allowed = fusion.allowed_documents(corpus.chunks, cfg)
    vectors = corpus.vectors.withColumnRenamed("doc_id", "vec_id")
    near = dense.top_k(dense.scores(asked, vectors, cfg.dense_candidates, exclude_self=True, allowed=allowed), cfg.dense_candidates).withColumnRenamed("vec_id", "doc_id")
    found = lexical.ranked(asked, corpus.index, cfg.lexical_candidates, id_col="q_id", text="effective_query", allowed=allowed) if cfg.use_hybrid else None
    return Searched(asked, stored(near, "near-ranked"), found if found is None else stored(found, "found-ranked"))


def find_candidates(searched: Searched, corpus: Corpus, cfg: RetrievalConfig) -> DataFrame:
    """The fused candidates of each question with exact dense scores, coverage and chunk metadata, without texts."""
    found, vectors = searched.found, corpus.vectors.withColumnRenamed("doc_id", "vec_id")
    if not cfg.use_hybrid:  # the dense list alone, its weight left out
        found = vectors.sparkSession.createDataFrame([], "q_id long, doc_id long, score double, lexical_rank long")
        cfg = cfg.with_overrides(dense_weight=1.0)
    found = found.withColumns({"coverage": F.lit(None).cast("double"), "matched_terms": F.lit(None).cast("array<string>")})
    top = stored(fusion.fused_top(fusion.candidates(searched.near, found, cfg), cfg.fusion_candidates).drop("coverage", "matched_terms"), "fused")
    exact = dense.lookup(top.filter("dense_score is null").select("q_id", F.col("doc_id").alias("vec_id")), searched.asked, vectors).select("q_id", F.col("vec_id").alias("doc_id"), F.col("dense_score").alias("exact"))
    out = lexical.described(top, searched.asked, corpus.index, id_col="q_id", text="effective_query").join(exact, ["q_id", "doc_id"], "left")
    # Only hits of the lexical list have matched terms.
    out = out.withColumns({"dense_score": F.coalesce("dense_score", "exact"), "matched_terms": F.when(F.col("lexical_rank").isNotNull(), F.col("matched_terms"))}).drop("exact")
    return out.join(corpus.chunks.drop("text"), "doc_id")


def retrieve(questions: DataFrame, corpus: Corpus, cfg: RetrievalConfig, rewriter: Chat | None = None, reranker: Chat | None = None, searched: Searched | None = None) -> Outcome:
    """All stages up to the contexts.  ``questions(q_id, query, history, has_assistant, q_vec)``.

    ``rerank_pass`` is null where reranking failed, was skipped or never came
    about: the answer goes on in fusion order, but no gate claims a success.
    Texts stay in the corpus and are joined where they are read, so no written
    table repeats them.
    """
    searched = searched or search(questions, corpus, cfg, rewriter)
    asked, texts = searched.asked, corpus.chunks.select("doc_id", "text")
    cands = stored(find_candidates(searched, corpus, cfg), "candidates")
    gate = fusion.gate(asked, cands, cfg)
    ready = cands.join(gate.filter("passed").select("q_id"), "q_id", "left_semi")
    if cfg.use_rerank and reranker is not None:
        prompted = ready.join(asked.select("q_id", F.col("effective_query").alias("query")), "q_id").join(texts, "doc_id")
        replies = stored(complete(answers.rerank_prompts(prompted), "prompt", reranker, json_mode=True).select("q_id", "reply"), "replies")
        ready = stored(answers.apply_scores(ready, replies), "reranked")
        scored = fusion.rerank_gate(ready, cfg).join(ready.groupBy("q_id").agg((~F.bool_and("rerank_ok")).alias("rerank_failed")), "q_id")
    else:
        ready = ready.withColumns({"single": F.lit(True), "rerank_ok": F.lit(True), "rerank_score": F.lit(None).cast("double"), "rerank_rank": F.col("fusion_rank")})
        scored = ready.select("q_id").distinct().withColumns({"rerank_pass": F.lit(None).cast("boolean"), "rerank_failed": F.lit(False)})
    contexts = stored(fusion.final_contexts(ready, cfg), "contexts")
    verdicts = asked.select("q_id", "query", "effective_query", "was_rewritten").join(gate, "q_id").join(scored, "q_id", "left")
    refused = ~F.col("passed") | ~F.coalesce("rerank_pass", F.lit(True))
    reason = F.when(F.col("refusal_reason") != "", F.col("refusal_reason")).when(refused, BELOW_RERANK).otherwise("")
    verdicts = verdicts.withColumns({"rerank_failed": F.coalesce("rerank_failed", F.lit(False)), "refused": refused, "refusal_reason": reason})
    order = ready.select("q_id", "doc_id", "rerank_score", "rerank_rank")
    every = stored(cands.join(order, ["q_id", "doc_id"], "left"), "ranked-candidates")
    return Outcome(stored(verdicts, "verdicts"), every.join(texts, "doc_id"), contexts.join(texts, "doc_id"))


def debug_candidates(outcome: Outcome) -> DataFrame:
    """Every candidate as a reader sees it, rounded, with a mark on those that became contexts."""
    used = outcome.contexts.select("q_id", "doc_id", F.lit(True).alias("was_used"))
    return outcome.candidates.join(used, ["q_id", "doc_id"], "left").select(
        "q_id", "doc_id", F.coalesce("was_used", F.lit(False)).alias("used"), "source_document", "page_label", F.when(F.coalesce("section_title", F.lit("")) == "", "-").otherwise(F.col("section_title")).alias("section"),
        fusion.retrieved_by(F.col("dense_rank"), F.col("lexical_rank")).alias("retrieved_by"), F.round("dense_score", 3).alias("dense"), F.round(F.coalesce("lexical_score", F.lit(0.0)), 2).alias("bm25"), F.round("fusion_score", 5).alias("rrf"), F.round("rerank_score", 1).alias("rerank"),
        F.concat(F.round(F.col("coverage") * 100).cast("int").cast("string"), F.lit("%")).alias("term_coverage"), F.when(F.coalesce(F.size("matched_terms"), F.lit(0)) > 0, F.array_join("matched_terms", ", ")).otherwise("-").alias("terms"),
    )


def generate(questions: DataFrame, outcome: Outcome, answerer: Chat) -> DataFrame:
    """``(q_id, answer, generation_error, refused, context_pages, contexts)``.

    Refused questions get the fixed refusal without a call.  The prompt holds
    the question as it was asked, not as it was rewritten; an error is no answer.
    """
    open_questions = outcome.verdicts.filter("not refused").select("q_id", "query")
    contexts = outcome.contexts.join(open_questions, "q_id").withColumn("document_label", F.regexp_replace("source_document", r"\.[^.]*$", ""))
    prompts = answers.answer_prompts(contexts, histories=questions.select("q_id", "history"))
    replies = stored(complete(prompts, "prompt", answerer).select("q_id", "reply", "reply_error"), "answers")
    held = contexts.groupBy("q_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("context_pages"))
    joined = outcome.verdicts.select("q_id", "query", "refused").join(replies, "q_id", "left").join(held, "q_id", "left")
    answer = F.when(F.col("refused"), F.lit(answers.no_context_answer())).otherwise(F.col("reply"))
    none = F.array().cast("array<int>")
    return joined.select("q_id", "query", "refused", answer.alias("answer"), F.col("reply_error").alias("generation_error"), F.coalesce(F.col("context_pages").cast("array<int>"), none).alias("context_pages"))


def guard(generated: DataFrame) -> DataFrame:
    """``generated`` as a reader may see it: diagnosis, replaced or stripped text, and the pages it cites.

    A refusal needs no citation; any other answer without a sound one is
    replaced by a fixed text.
    """
    code = F.when(~F.col("refused"), answers.diagnosis(F.coalesce("answer", F.lit("")), F.col("context_pages")))
    out = generated.withColumn("diagnosis", F.coalesce(code, F.lit("")))
    shown = F.when(F.col("diagnosis") != "", F.lit(answers.unverified_answer())).otherwise(F.col("answer"))
    out = out.withColumn("shown", shown).withColumn("cited_pages", answers.cited_pages(F.col("shown")))
    return out.withColumn("display", answers.strip_source_lines(F.col("shown"))).drop("shown")


def cited_cards(outcome: Outcome, guarded: DataFrame) -> DataFrame:
    """Source cards of each answered question: of the contexts that share a cited page, or of all where none is cited."""
    cites = guarded.filter("not refused").select("q_id", "cited_pages")
    rows = outcome.contexts.join(cites, "q_id").withColumn("page_numbers", F.col("page_numbers").cast("array<int>"))
    return answers.source_cards(answers.cited_contexts(rows).withColumn("score", fusion.display_score(F.col("rerank_score"), F.col("dense_score"))))


def chat_turns(questions: DataFrame, outcome: Outcome, answerer: Chat, limits: DataFrame | None = None) -> DataFrame:
    """One row for each question of a conversation: what the user gets and why.

    ``limits(q_id, allowed, retry_after)`` are the rate limiter's decisions; a
    denied question is answered by nothing else and asks no provider.
    """
    if limits is not None:
        denied = limits.filter("not allowed").select("q_id", F.col("retry_after"))
        questions = questions.join(denied, "q_id", "left_anti")
        outcome = Outcome(*(x.join(denied, "q_id", "left_anti") for x in (outcome.verdicts, outcome.candidates, outcome.contexts)))
    seen = guard(generate(questions, outcome, answerer))
    cards = cited_cards(outcome, seen).groupBy("q_id").agg(F.count("*").alias("n_cards"))
    status = F.when(F.col("refused"), "refused").when(F.col("diagnosis") != "", "unverified").otherwise("answered")
    out = seen.join(cards, "q_id", "left").select("q_id", status.alias("status"), "display", "diagnosis", "cited_pages", F.when(F.col("refused"), F.lit(0)).otherwise(F.coalesce("n_cards", F.lit(0))).cast("long").alias("n_cards"))
    if limits is None:
        return out
    none = F.array().cast("array<int>")
    return out.unionByName(denied.select("q_id", F.lit("rate_limited").alias("status"), F.lit("").alias("display"), F.lit("").alias("diagnosis"), none.alias("cited_pages"), F.lit(0).cast("long").alias("n_cards")))
