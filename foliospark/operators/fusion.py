"""Rank fusion, candidate assembly and relevance gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import RetrievalConfig


def allowed_documents(docs: DataFrame, cfg: RetrievalConfig, d_id: str = "doc_id", document: str = "source_document") -> DataFrame | None:
    """Ids of the documents that the filter of ``cfg`` names, or None for no restriction.

    No filter, and a filter that names every document, restrict nothing.
    """
    if not cfg.document_filter:
        return None
    chosen = F.col(document).isin(*cfg.document_filter)
    if docs.filter(~F.coalesce(chosen, F.lit(False))).isEmpty():
        return None
    return docs.filter(chosen).select(d_id)


def reciprocal_rank(ranked: dict[str, DataFrame], weights: dict[str, float] | None = None, rrf_k: int = 60, q_id: str = "q_id", d_id: str = "doc_id") -> DataFrame:
    """Sum of ``weight / (k + rank)`` over any number of lists ``(q, d, rank)``."""
    weights = weights or {}
    parts = [df.select(q_id, d_id, (F.lit(float(weights.get(name, 1.0))) / (F.lit(rrf_k) + F.col("rank"))).alias("w")) for name, df in ranked.items()]
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy(q_id, d_id).agg(F.round(F.sum("w"), 9).alias("fusion_score"))


def candidates(dense: DataFrame, lexical: DataFrame, cfg: RetrievalConfig, q_id: str = "q_id", d_id: str = "doc_id") -> DataFrame:
    """Both lists side by side with a fusion score; either rank may be null.

    A union and one grouping instead of an outer join: it takes any number of
    lists and a key never becomes null.
    """
    a = dense.select(q_id, d_id, "dense_score", "dense_rank", F.lit(None).cast("double").alias("lexical_score"), F.lit(None).cast("long").alias("lexical_rank"), F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("array<string>").alias("matched_terms"))
    b = lexical.select(q_id, d_id, F.lit(None).cast("double").alias("dense_score"), F.lit(None).cast("long").alias("dense_rank"), F.col("score").alias("lexical_score"), "lexical_rank", "coverage", "matched_terms")
    both = a.unionByName(b).groupBy(q_id, d_id).agg(*[F.max(c).alias(c) for c in ("dense_score", "dense_rank", "lexical_score", "lexical_rank", "coverage", "matched_terms")])
    part = lambda w, rank: F.coalesce(F.lit(float(w)) / (F.lit(cfg.rrf_k) + F.col(rank)), F.lit(0.0))
    return both.withColumn("fusion_score", F.round(part(cfg.dense_weight, "dense_rank") + part(cfg.lexical_weight, "lexical_rank"), 9))


def fused_top(df: DataFrame, n: int, q_id: str = "q_id", d_id: str = "doc_id") -> DataFrame:
    """The fused order: fusion, then dense score, then list order; ranked from 1."""
    order = Window.partitionBy(q_id).orderBy(F.desc("fusion_score"), F.desc(F.coalesce("dense_score", F.lit(0.0))), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), d_id)
    return df.withColumn("fusion_rank", F.row_number().over(order).cast("long")).filter(F.col("fusion_rank") <= n)


def retrieved_by(dense_rank: Column, lexical_rank: Column) -> Column:
    return F.when(dense_rank.isNotNull() & lexical_rank.isNotNull(), "dense+bm25").when(dense_rank.isNotNull(), "dense").when(lexical_rank.isNotNull(), "bm25").otherwise("-")


def gate(questions: DataFrame, cands: DataFrame, cfg: RetrievalConfig, q_id: str = "q_id") -> DataFrame:
    """The cheap gate of each question, those without candidates included.

    Passed by the best dense score, or by one candidate with enough coverage
    and matched terms and a dense score not far below the threshold.  Only
    lexical hits have matched terms, so a dense-only candidate cannot rescue.
    """
    rescue = (F.col("coverage") >= cfg.lexical_coverage_threshold) & (F.coalesce(F.size("matched_terms"), F.lit(0)) >= cfg.rescue_min_terms) & (F.col("dense_score") >= cfg.rescue_dense_ratio * cfg.dense_threshold)
    found = cands.groupBy(q_id).agg(F.count("*").alias("n_candidates"), F.max("dense_score").alias("max_dense_score"), F.max(F.coalesce("coverage", F.lit(0.0))).alias("max_lexical_coverage"), F.bool_or(F.coalesce(rescue, F.lit(False))).alias("lexical_pass"))
    out = questions.select(q_id).join(found, q_id, "left").select(
        q_id,
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.coalesce("max_dense_score", F.lit(0.0)).alias("max_dense_score"),
        F.coalesce("max_lexical_coverage", F.lit(0.0)).alias("max_lexical_coverage"),
        F.coalesce("lexical_pass", F.lit(False)).alias("lexical_pass"),
    )
    out = out.withColumn("dense_pass", (F.col("n_candidates") > 0) & (F.col("max_dense_score") >= cfg.dense_threshold))
    out = out.withColumn("passed", F.col("dense_pass") | F.col("lexical_pass"))
    reason = F.when(F.col("n_candidates") == 0, "no_candidates").when(~F.col("passed"), "below_relevance_gate").otherwise("")
    return out.withColumn("refusal_reason", reason)


def rerank_gate(cands: DataFrame, cfg: RetrievalConfig, q_id: str = "q_id") -> DataFrame:
    """``rerank_pass`` of each question: true, false, or null.

    Null if reranking failed or was skipped (one candidate at most): the answer
    goes on, but the gate does not claim a success.  A missing score counts as
    0.0 only where reranking worked.
    """
    ok = F.bool_and("rerank_ok") & (F.count("*") > 1)
    passed = F.bool_or(F.coalesce("rerank_score", F.lit(0.0)) >= cfg.rerank_min_score)
    return cands.groupBy(q_id).agg(F.when(ok, passed).alias("rerank_pass"))


def final_contexts(cands: DataFrame, cfg: RetrievalConfig, q_id: str = "q_id") -> DataFrame:
    """Reranked order, the threshold where reranking worked, and the top k."""
    kept = cands.filter(~F.col("rerank_ok") | F.col("rerank_score").isNull() & F.col("single") | (F.coalesce("rerank_score", F.lit(0.0)) >= cfg.rerank_min_score))
    order = Window.partitionBy(q_id).orderBy(F.desc_nulls_last("rerank_score"), "fusion_rank")
    return kept.withColumn("final_rank", F.row_number().over(order).cast("long")).filter(F.col("final_rank") <= cfg.top_k)


def display_score(rerank: Column, dense: Column) -> Column:
    return F.coalesce(rerank / 10.0, dense)
