"""Scoring of questions and answers, and their metrics as single conditional aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.providers import Chat, complete
from ..storage import stored
from . import answers


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _ratio(hits: Column, total: Column) -> Column:
    return F.when(total > 0, hits / total).otherwise(F.lit(0.0))


def select_questions(questions: DataFrame, category: str | None = None, limit: int | None = None, conversational: bool | None = None) -> DataFrame:
    """Questions of a category, with or without a history, the first ``limit`` by id."""
    out = questions if category is None else questions.filter(F.col("category") == category)
    if conversational is not None:
        out = out.filter(F.col("is_conversational") == F.lit(conversational))
    return out if limit is None else out.orderBy("q_id").limit(limit)


def force_rewrite(questions: DataFrame, use_query_rewrite: bool) -> bool:
    """Rewriting is on for all presets as soon as one question has a history."""
    return use_query_rewrite or not questions.filter("is_conversational").isEmpty()


def first_relevant(contexts: DataFrame, expected: DataFrame, q_id: str = "q_id", rank: str = "final_rank") -> DataFrame:
    """``(q_id, first_relevant_rank, reciprocal_rank)`` of the questions in ``expected(q_id, expected_pages)``.

    A context is relevant if it shares a page with the expected ones; 0.0 without such a context.
    """
    hit = contexts.join(expected, q_id).filter(F.arrays_overlap("page_numbers", "expected_pages")).groupBy(q_id).agg(F.min(rank).alias("first_relevant_rank"))
    out = expected.select(q_id).join(hit, q_id, "left")
    return out.withColumn("reciprocal_rank", F.coalesce(F.lit(1.0) / F.col("first_relevant_rank"), F.lit(0.0)))


def missing_keywords(keywords: Column, text: Column) -> Column:
    """Expected keywords that the lower-cased text lacks; an empty list is no hit."""
    return F.filter(keywords, lambda k: ~F.contains(F.lower(text), F.lower(k)))


def score_questions(questions: DataFrame, outcome) -> DataFrame:
    """What retrieval made of each question, as ``retrieval_metrics`` reads it.

    ``questions(q_id, category, is_conversational, expected_pages, expected_keywords)``.
    All keywords must occur in the contexts; a question without any has no keyword hit.
    """
    held = outcome.contexts.groupBy("q_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("retrieved_pages"), F.array_sort(F.collect_list(F.struct("final_rank", F.lower(F.coalesce("text", F.lit(""))).alias("t")))).alias("texts")
    )
    best = outcome.candidates.groupBy("q_id").agg(F.max("dense_score").alias("top"))
    ranks = first_relevant(outcome.contexts, questions.select("q_id", "expected_pages"))
    verdicts = outcome.verdicts.select("q_id", "refused", "refusal_reason", "was_rewritten", "rerank_failed", "passed", "rerank_pass")
    rows = questions.join(verdicts, "q_id").join(held, "q_id", "left").join(best, "q_id", "left").join(ranks, "q_id")
    missing = missing_keywords(F.col("expected_keywords"), F.coalesce(F.array_join(F.transform("texts", lambda t: t["t"]), " "), F.lit("")))
    rows = rows.withColumn("missing_keywords", missing)
    return rows.select(
        "q_id", "category", "is_conversational", (F.size("expected_pages") > 0).alias("has_expected_pages"), F.coalesce("retrieved_pages", F.array().cast("array<long>")).alias("retrieved_pages"),
        F.col("first_relevant_rank").isNotNull().alias("page_hit"), "first_relevant_rank", "reciprocal_rank", (F.size("expected_keywords") > 0).alias("has_keywords"), "missing_keywords",
        ((F.size("expected_keywords") > 0) & (F.size("missing_keywords") == 0)).alias("keyword_hit"), "refused", "refusal_reason", "was_rewritten", "rerank_failed", "passed", "rerank_pass", F.round(F.coalesce("top", F.lit(0.0)), 4).alias("top_dense_score"),
    )


def score_answers(questions: DataFrame, outcome, generated: DataFrame, judge: Chat | None = None) -> DataFrame:
    """What became of each answer, as ``answer_metrics`` reads it.

    ``questions(q_id, category, expected_pages)``, ``generated`` from the
    pipeline.  A refused question is neither generated nor judged; a failed
    generation keeps out of every judgement; a failed judge is no score of zero.
    """
    rows = generated.join(questions.select("q_id", "category", "expected_pages"), "q_id")
    failed = F.col("generation_error").isNotNull()
    rows = rows.withColumns({"generation_failed": failed, "refused_in_answer": ~F.col("refused") & ~failed & answers.is_refusal(F.col("answer")), "cited_pages": F.when(F.col("refused") | failed, F.array().cast("array<int>")).otherwise(answers.cited_pages(F.col("answer")))})
    rows = rows.withColumns({name: F.when(F.col("refused") | failed, F.lit(0.0 if name == "citation_precision" else False)).otherwise(c) for name, c in answers.citation_check(F.col("cited_pages"), F.col("context_pages")).items() if name != "invalid_pages"})
    rows = rows.withColumn("cites_expected_page", F.arrays_overlap("cited_pages", F.col("expected_pages").cast("array<int>")))
    if judge is None:
        verdict = rows.select("q_id").limit(0).withColumn("v", F.lit(None).cast("struct<score:double,unsupported_claims:array<string>,judge_failed:boolean>"))
    else:
        prompts = answers.judge_prompts(outcome.contexts, rows.filter(~(F.col("refused") | F.col("generation_failed") | F.col("refused_in_answer"))))
        replies = stored(complete(prompts, "prompt", judge, json_mode=True).select("q_id", "reply"), "verdicts")
        verdict = replies.select("q_id", answers.parse_verdict("reply").alias("v"))
    rows = rows.join(verdict, "q_id", "left")
    return rows.select(
        "q_id", "category", (F.col("refused") | F.col("refused_in_answer")).alias("refused"), F.col("refused").alias("refused_by_retrieval"), "refused_in_answer", "generation_failed", "cited_pages", "context_pages", "has_citation", "citation_valid", "citation_precision", "cites_expected_page",
        F.col("v.score").alias("groundedness_score"), F.coalesce("v.unsupported_claims", F.array().cast("array<string>")).alias("unsupported_claims"), answers.is_grounded(F.col("v.score")).alias("grounded"), F.coalesce("v.judge_failed", F.lit(False)).alias("judge_failed"),
    )


def total_ms(timings: Column) -> Column:
    """The sum of a map of stage timings."""
    return F.aggregate(F.map_values(timings), F.lit(0.0), lambda acc, x: acc + x)


def compare(metrics: DataFrame, by: str = "preset") -> DataFrame:
    """One row for each metric with a column for each preset."""
    names = [c for c in metrics.columns if c != by]
    rows = metrics.select(by, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([by], names, "metric", "value")
    return rows.groupBy("metric").pivot(by).agg(F.first("value"))


def save_run(results: DataFrame, metrics: DataFrame, path: str, partial: bool = False) -> str:
    """Rows by preset and metrics as JSON; a partial run goes beside a full one and never over it."""
    target = f"{path.rstrip('/')}{'-partial' if partial else ''}"
    results.write.mode("overwrite").partitionBy("preset").json(f"{target}/results")
    metrics.coalesce(1).write.mode("overwrite").json(f"{target}/metrics")
    return target


def run_presets(presets: dict, evaluate_one) -> DataFrame:
    """The scored questions of every preset; ``evaluate_one(config)`` gives those of one."""
    return reduce(DataFrame.unionByName, [evaluate_one(cfg).withColumn("preset", F.lit(name)) for name, cfg in presets.items()])


def retrieval_metrics(results: DataFrame, by: str = "preset") -> DataFrame:
    """One row for each preset.

    Recall and reciprocal rank are over in-scope rows with expected pages,
    keywords over in-scope rows with keywords, refusals over out-of-scope rows,
    false refusals over all in-scope rows, latency over all rows.
    """
    inside, outside = F.col("category") == "in_scope", F.col("category") == "out_of_scope"
    scorable, worded, talk = inside & F.col("has_expected_pages"), inside & F.col("has_keywords"), inside & F.col("is_conversational")
    out = results.groupBy(by).agg(
        _count(F.col("rerank_failed")).alias("rerank_failures"), _count(scorable & F.col("page_hit")).alias("page_recall_hits"), _count(scorable).alias("page_recall_total"),
        F.avg(F.when(scorable, F.col("reciprocal_rank"))).alias("mrr"), _count(worded & F.col("keyword_hit")).alias("keyword_hits"), _count(worded).alias("keyword_total"),
        _count(outside & F.col("refused")).alias("correct_refusals"), _count(outside).alias("out_of_scope_total"), _count(inside & F.col("refused")).alias("false_refusals"), _count(inside).alias("in_scope_total"),
        _count(talk & F.col("page_hit")).alias("conversational_hits"), _count(talk).alias("conversational_total"), F.avg("latency_ms").alias("avg_latency_ms"), F.median("latency_ms").alias("median_latency_ms"),
    )
    ratios = {"page_recall": ("page_recall_hits", "page_recall_total"), "keyword_coverage": ("keyword_hits", "keyword_total"), "refusal_accuracy": ("correct_refusals", "out_of_scope_total"), "false_refusal_rate": ("false_refusals", "in_scope_total"), "conversational_recall": ("conversational_hits", "conversational_total")}
    return out.withColumns({n: _ratio(F.col(a), F.col(b)) for n, (a, b) in ratios.items()}).withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("mrr", "avg_latency_ms", "median_latency_ms")})


def answer_metrics(results: DataFrame, by: str = "preset") -> DataFrame:
    """One row for each preset.

    Failed generations count only in ``total``, ``generation_failures`` and the
    latency; judged rows leave failed judges out; precision is over cited rows.
    """
    usable = ~F.col("generation_failed")
    inside, outside = usable & (F.col("category") == "in_scope"), usable & (F.col("category") == "out_of_scope")
    answered = inside & ~F.col("refused")
    judged = answered & ~F.col("judge_failed") & F.col("groundedness_score").isNotNull()
    cited = answered & F.col("has_citation")
    out = results.groupBy(by).agg(
        F.count("*").alias("total"), _count(~usable).alias("generation_failures"), _count(inside).alias("in_scope_total"), _count(outside).alias("out_of_scope_total"), _count(answered).alias("answered_total"),
        _count(judged).alias("judged_total"), _count(answered & F.col("judge_failed")).alias("judge_failures"), _count(judged & F.col("grounded")).alias("n_grounded"), F.avg(F.when(judged, F.col("groundedness_score"))).alias("avg_groundedness_score"),
        _count(cited).alias("n_cited"), _count(answered & F.col("citation_valid")).alias("n_valid"), F.avg(F.when(cited, F.col("citation_precision"))).alias("avg_citation_precision"), _count(answered & F.col("cites_expected_page")).alias("n_expected"),
        _count(outside & F.col("refused")).alias("n_refused_out"), _count(inside & F.col("refused")).alias("n_refused_in"), F.avg("latency_ms").alias("avg_latency_ms"),
    )
    ratios = {"groundedness_rate": ("n_grounded", "judged_total"), "citation_presence": ("n_cited", "answered_total"), "citation_validity": ("n_valid", "answered_total"), "cites_expected_page": ("n_expected", "answered_total"), "refusal_accuracy_e2e": ("n_refused_out", "out_of_scope_total"), "false_refusal_e2e": ("n_refused_in", "in_scope_total")}
    out = out.withColumns({n: _ratio(F.col(a), F.col(b)) for n, (a, b) in ratios.items()})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("avg_groundedness_score", "avg_citation_precision", "avg_latency_ms")}).drop("n_grounded", "n_cited", "n_valid", "n_expected", "n_refused_out", "n_refused_in")
