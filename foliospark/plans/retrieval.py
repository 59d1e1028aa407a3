"""Queries of the lexical, dense and fusion operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import PRESETS, RetrievalConfig
from ..functions.text import tokens
from ..operators import answers, dense, fusion, lexical
from ..storage import once
from . import duck

# Benchmark ids lie in the range of vector ids, so a vector stands in for its
# question's embedding; self matches are left out, and the threshold suits the
# score range that remains.
CONFIG = RetrievalConfig(dense_threshold=0.35)
SOURCES = ("src1", "src3", "src5")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored_index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    """The index of the documents table: built once an application, then read by every query."""
    return once(spark, f"{sf}/documents.parquet", "lexical", lambda: lexical.build_stored(_table(spark, sf, "documents")))


def token_stream(spark, sf):
    return tokens(_table(spark, sf, "documents"), "text", "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"))


def term_frequency(spark, sf):
    return stored_index(spark, sf).tf


def doc_length(spark, sf):
    return stored_index(spark, sf).lengths


def doc_frequency(spark, sf):
    return stored_index(spark, sf).df


def corpus_stats(spark, sf):
    index = stored_index(spark, sf)
    vocabulary = index.df.agg(F.count("*").alias("vocabulary"))
    return index.corpus.crossJoin(F.broadcast(vocabulary)).select("n", F.round("avgdl", 6).alias("avgdl"), "vocabulary")


def idf_table(spark, sf):
    return lexical.idf_table(stored_index(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


def _hits(spark, sf):
    return lexical.bm25(_table(spark, sf, "benchmark"), stored_index(spark, sf))


def _found(spark, sf, n):
    """The ``n`` best documents of each item with their matched terms."""
    return lexical.search(_table(spark, sf, "benchmark"), stored_index(spark, sf), n)


def bm25_topk(spark, sf):
    return lexical.ranked(_table(spark, sf, "benchmark"), stored_index(spark, sf), 20).select("item_id", "doc_id", "score", "lexical_rank")


def lexical_coverage(spark, sf):
    return _hits(spark, sf).filter("coverage >= 0.5").select("item_id", "doc_id", "coverage")


def matched_terms(spark, sf):
    return _found(spark, sf, 5).select("item_id", "doc_id", F.array_join("matched_terms", " ").alias("terms"), F.size("matched_terms").cast("long").alias("n_terms"))


def _questions(spark, sf):
    items = _table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), "text")
    vectors = _table(spark, sf, "embeddings")
    return items.join(vectors.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec")), "q_id")


def _dense(spark, sf, n=20):
    scored = dense.scores(_questions(spark, sf), _table(spark, sf, "embeddings"), n, exclude_self=True)
    return dense.top_k(scored, n)


def dense_topk(spark, sf):
    return _dense(spark, sf)


def dense_threshold_search(spark, sf):
    scored = dense.scores(_questions(spark, sf), _table(spark, sf, "embeddings"), 4, exclude_self=True)
    return dense.threshold_search(scored, 4, 0.30)


def dense_score_lookup(spark, sf):
    hits = lexical.ranked(_table(spark, sf, "benchmark"), stored_index(spark, sf), 20).select(F.col("item_id").alias("q_id"), F.col("doc_id").alias("vec_id"))
    return dense.lookup(hits, _questions(spark, sf).select("q_id", "q_vec"), _table(spark, sf, "embeddings"))


def vector_index(spark, sf):
    """Unit vectors as an index stores them: first and last component and the length."""
    v = dense.normalized(_table(spark, sf, "embeddings"))
    d = F.col("embedding").cast("array<double>")
    return v.select("vec_id", F.size(d).cast("long").alias("dimension"), F.round(d[0], 5).alias("first"), F.round(F.element_at(d, -1), 5).alias("last"), F.round(F.sqrt(dense.dot(d, d)), 5).alias("length"))


def content_terms(spark, sf):
    """Distinct terms of each item in the order of their first occurrence."""
    found = lexical.content_terms(_table(spark, sf, "benchmark"), "text", "item_id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    return found.select("item_id", F.array_join(F.transform("t", lambda x: x["term"]), " ").alias("terms"))


def _lists(spark, sf):
    d = _dense(spark, sf).withColumnRenamed("vec_id", "doc_id")
    lx = _found(spark, sf, 20).withColumnRenamed("item_id", "q_id")
    return d, lx


def _ranked(spark, sf):
    d, lx = _lists(spark, sf)
    return {"dense": d.select("q_id", "doc_id", F.col("dense_rank").alias("rank")), "lexical": lx.select("q_id", "doc_id", F.col("lexical_rank").alias("rank"))}


def rrf_fusion(spark, sf):
    return fusion.reciprocal_rank(_ranked(spark, sf))


def rrf_weighted(spark, sf):
    return fusion.reciprocal_rank(_ranked(spark, sf), {"dense": 0.7, "lexical": 1.3}, rrf_k=40)


def dense_only_fusion(spark, sf):
    return fusion.reciprocal_rank({"dense": _ranked(spark, sf)["dense"]}).select("q_id", "doc_id", "fusion_score")


def _candidates(spark, sf):
    """Fused candidates with exact dense scores and coverage filled in."""
    d, lx = _lists(spark, sf)
    top = fusion.fused_top(fusion.candidates(d, lx, CONFIG), CONFIG.fusion_candidates)
    exact = dense.lookup(top.select("q_id", F.col("doc_id").alias("vec_id")), _questions(spark, sf).select("q_id", "q_vec"), _table(spark, sf, "embeddings")).select("q_id", F.col("vec_id").alias("doc_id"), F.col("dense_score").alias("exact"))
    wanting = top.filter("coverage is null").select(F.col("q_id").alias("item_id"), "doc_id")
    covered = lexical.coverage(_table(spark, sf, "benchmark"), stored_index(spark, sf), wanting).select(F.col("item_id").alias("q_id"), "doc_id", F.col("coverage").alias("full"))
    out = top.join(exact, ["q_id", "doc_id"]).join(covered, ["q_id", "doc_id"], "left")
    return out.withColumn("dense_score", F.coalesce("dense_score", "exact")).withColumn("coverage", F.coalesce("coverage", "full", F.lit(0.0))).drop("exact", "full")


def candidate_profile(spark, sf):
    c = _candidates(spark, sf)
    return c.select("q_id", "doc_id", "fusion_score", "fusion_rank", "dense_score", "coverage", fusion.retrieved_by(F.col("dense_rank"), F.col("lexical_rank")).alias("retrieved_by"), F.coalesce(F.size("matched_terms"), F.lit(0)).cast("long").alias("n_matched"))


def relevance_gate(spark, sf):
    return fusion.gate(_questions(spark, sf), _candidates(spark, sf), CONFIG)


def _allowed(spark, sf):
    """Documents of the chosen sources; null where all sources are chosen, which is no filter."""
    docs = _table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_document"))
    return fusion.allowed_documents(docs, RetrievalConfig(document_filter=SOURCES))


def document_filter_topk(spark, sf):
    return lexical.search(_table(spark, sf, "benchmark"), stored_index(spark, sf), 10, allowed=_allowed(spark, sf)).select("item_id", "doc_id", "score", "lexical_rank")


def document_filter_dense(spark, sf):
    scored = dense.scores(_questions(spark, sf), _table(spark, sf, "embeddings"), 10, exclude_self=True, allowed=_allowed(spark, sf))
    return dense.top_k(scored, 10)


def ablation_presets(spark, sf):
    """Size of the contexts of the presets that need no reranker; ``preset_metrics`` runs all three."""
    d, lx = _lists(spark, sf)
    fused = fusion.fused_top(fusion.candidates(d, lx, CONFIG), CONFIG.fusion_candidates).select("q_id", "doc_id", F.col("fusion_rank").alias("rank"))
    runs = d.select(F.lit("dense").alias("preset"), "q_id", "doc_id", F.col("dense_rank").alias("rank")).filter(f"rank <= {CONFIG.top_k}")
    runs = runs.unionByName(fused.select(F.lit("hybrid").alias("preset"), "q_id", "doc_id", "rank").filter(f"rank <= {CONFIG.top_k}"))
    best = runs.groupBy("preset").agg(F.countDistinct("q_id").alias("n_questions"), F.count("*").alias("n_contexts"), F.countDistinct("doc_id").alias("n_documents"))
    names = spark.createDataFrame([(n, c.use_hybrid, c.use_rerank) for n, c in PRESETS.items()], "preset string, use_hybrid boolean, use_rerank boolean")
    return F.broadcast(names).join(best, "preset", "left").select("preset", "use_hybrid", "use_rerank", F.coalesce("n_questions", F.lit(0)).alias("n_questions"), F.coalesce("n_contexts", F.lit(0)).alias("n_contexts"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def offline_replies(cands):
    """A deterministic reranker's reply for each question: ten times the coverage of each candidate."""
    entry = F.struct(F.col("fusion_rank").alias("id"), (F.col("coverage") * 10).alias("score"))
    return cands.groupBy("q_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("reply"))


def preset_metrics(spark, sf):
    """Hits and mean reciprocal rank of each preset over all questions; relevant is a document that contains the question's text.

    The third preset reranks the fused candidates by ``offline_replies`` and drops those under the threshold.
    """
    cands = _candidates(spark, sf)
    final = fusion.final_contexts(answers.apply_scores(cands, offline_replies(cands)), CONFIG)
    runs = {
        "dense": _dense(spark, sf).select("q_id", F.col("vec_id").alias("doc_id"), F.col("dense_rank").alias("rank")),
        "hybrid": cands.select("q_id", "doc_id", F.col("fusion_rank").alias("rank")),
        "hybrid_rerank": final.select("q_id", "doc_id", F.col("final_rank").cast("long").alias("rank")),
    }
    every = None
    for name, run in runs.items():
        one = run.filter(F.col("rank") <= CONFIG.top_k).select(F.lit(name).alias("preset"), "q_id", "doc_id", "rank")
        every = one if every is None else every.unionByName(one)
    questions = _questions(spark, sf).select("q_id", F.lower("text").alias("q_text"))
    texts = _table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    held = F.coalesce((F.col("q_text") != "") & F.contains("text", F.col("q_text")), F.lit(False))
    ranked = every.join(questions, "q_id").join(texts, "doc_id", "left").groupBy("preset", "q_id").agg(F.count("*").alias("n"), F.coalesce(F.max(F.when(held, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    found = ranked.groupBy("preset").agg(F.count("*").alias("n_answered"), F.sum("n").alias("n_contexts"), F.count_if(F.col("rr") > 0).alias("n_hit"), F.sum("rr").alias("rr"))
    total = questions.agg(F.count("*").alias("n_questions"))
    names = spark.createDataFrame([(n,) for n in PRESETS], "preset string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return F.broadcast(names).join(found, "preset", "left").crossJoin(F.broadcast(total)).select("preset", "n_questions", zero("n_answered"), zero("n_contexts"), zero("n_hit"), F.round(F.coalesce(F.col("rr") / F.col("n_questions"), F.lit(0.0)), 6).alias("mrr"))


QUERIES = {f.__name__: f for f in (token_stream, content_terms, vector_index, term_frequency, doc_length, doc_frequency, corpus_stats, idf_table, bm25_topk, lexical_coverage, matched_terms, dense_topk, dense_threshold_search, dense_score_lookup, rrf_fusion, rrf_weighted, dense_only_fusion, candidate_profile, relevance_gate, document_filter_topk, document_filter_dense, ablation_presets, preset_metrics)}

_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS lexical_rank FROM hits)"
_DENSE = f"""ds AS (
            SELECT a.vec_id AS q_id, b.vec_id AS doc_id, {duck.UNIT_DOT} AS dense_score
            FROM embeddings a JOIN benchmark ON item_id = a.vec_id JOIN embeddings b ON a.vec_id <> b.vec_id),
        dense AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dense_score DESC, doc_id) AS dense_rank FROM ds)"""
_LISTS = f"""{duck.bm25()}, {_TOP}, {_DENSE},
        d AS (SELECT * FROM dense WHERE dense_rank <= 20),
        l AS (SELECT top.*, item_id AS q_id FROM top WHERE lexical_rank <= 20)"""
_CANDIDATES = f"""{_LISTS},
        fused AS (
            SELECT coalesce(d.q_id, l.q_id) AS q_id, coalesce(d.doc_id, l.doc_id) AS doc_id, dense_score, dense_rank, lexical_rank, coverage, matched_terms,
                   round(coalesce(1e0 / (60 + dense_rank), 0) + coalesce(1e0 / (60 + lexical_rank), 0), 9) AS fusion_score
            FROM d FULL JOIN l ON d.q_id = l.q_id AND d.doc_id = l.doc_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY fusion_score DESC, coalesce(dense_score, 0e0) DESC, dense_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST, doc_id) AS fusion_rank FROM fused),
        cand AS (
            SELECT r.q_id, r.doc_id, fusion_score, fusion_rank, dense_rank, lexical_rank, r.matched_terms,
                   coalesce(r.dense_score, CASE WHEN b.vec_id IS NULL THEN 0e0 ELSE {duck.UNIT_DOT} END) AS dense_score,
                   coalesce(r.coverage, h.coverage, 0e0) AS coverage
            FROM ranked r LEFT JOIN embeddings a ON a.vec_id = r.q_id LEFT JOIN embeddings b ON b.vec_id = r.doc_id
            LEFT JOIN hits h ON h.item_id = r.q_id AND h.doc_id = r.doc_id WHERE fusion_rank <= 10)"""
_RRF = "WITH {lists} SELECT q_id, doc_id, round(sum(w), 9) AS fusion_score FROM (SELECT q_id, doc_id, {wd}e0 / ({k} + dense_rank) AS w FROM d UNION ALL SELECT q_id, doc_id, {wl}e0 / ({k} + lexical_rank) FROM l) GROUP BY ALL"

ORACLE_SQL = {
    "token_stream": f"WITH {duck.tokens('tok', 'documents', 'doc_id')} SELECT doc_id, term, count(*) AS n, min(pos) AS first_pos FROM tok GROUP BY ALL",
    "content_terms": f"WITH {duck.tokens('tok', 'benchmark', 'item_id')}, f AS (SELECT item_id, term, min(pos) AS pos FROM tok GROUP BY ALL) SELECT item_id, string_agg(term, ' ' ORDER BY pos) AS terms FROM f GROUP BY ALL",
    "vector_index": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
        SELECT vec_id, len(e) AS dimension, round(CAST(CAST(e[1] / n AS FLOAT) AS DOUBLE), 5) AS first, round(CAST(CAST(e[len(e)] / n AS FLOAT) AS DOUBLE), 5) AS last, round(n / n, 5) AS length FROM v""",
    "term_frequency": f"WITH {duck.index()} SELECT doc_id, term, tf FROM tf",
    "doc_length": f"WITH {duck.index()} SELECT doc_id, CAST(dl AS BIGINT) AS dl FROM dl",
    "doc_frequency": f"WITH {duck.index()} SELECT term, df FROM df",
    "corpus_stats": f"WITH {duck.index()} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS vocabulary FROM corpus",
    "idf_table": f"WITH {duck.index()} SELECT term, df, round(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)), 6) AS idf FROM df, corpus",
    "bm25_topk": f"WITH {duck.bm25()}, {_TOP} SELECT item_id, doc_id, score, lexical_rank FROM top WHERE lexical_rank <= 20",
    "lexical_coverage": f"WITH {duck.bm25()} SELECT item_id, doc_id, coverage FROM hits WHERE coverage >= 5e-1",
    "matched_terms": f"WITH {duck.bm25()}, {_TOP} SELECT item_id, doc_id, array_to_string(matched_terms, ' ') AS terms, CAST(len(matched_terms) AS BIGINT) AS n_terms FROM top WHERE lexical_rank <= 5",
    "dense_topk": f"WITH {_DENSE} SELECT q_id, doc_id AS vec_id, dense_score, dense_rank FROM dense WHERE dense_rank <= 20",
    "dense_threshold_search": f"WITH {_DENSE} SELECT q_id, doc_id AS vec_id, dense_score, dense_rank FROM dense WHERE dense_rank <= 4 AND dense_score >= 3e-1",
    "dense_score_lookup": f"WITH {duck.bm25()}, {_TOP} SELECT t.item_id AS q_id, t.doc_id AS vec_id, CASE WHEN a.vec_id IS NULL OR b.vec_id IS NULL THEN 0e0 ELSE {duck.UNIT_DOT} END AS dense_score FROM top t LEFT JOIN embeddings a ON a.vec_id = t.item_id LEFT JOIN embeddings b ON b.vec_id = t.doc_id WHERE lexical_rank <= 20",
    "rrf_fusion": _RRF.format(lists=_LISTS, wd=1, wl=1, k=60),
    "rrf_weighted": _RRF.format(lists=_LISTS, wd=0.7, wl=1.3, k=40),
    "dense_only_fusion": f"WITH {_DENSE} SELECT q_id, doc_id, round(1e0 / (60 + dense_rank), 9) AS fusion_score FROM dense WHERE dense_rank <= 20",
    "candidate_profile": f"WITH {_CANDIDATES} SELECT q_id, doc_id, fusion_score, fusion_rank, dense_score, coverage, CASE WHEN dense_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 'dense+bm25' WHEN dense_rank IS NOT NULL THEN 'dense' ELSE 'bm25' END AS retrieved_by, CAST(coalesce(len(matched_terms), 0) AS BIGINT) AS n_matched FROM cand",
    "relevance_gate": f"""WITH {_CANDIDATES},
        g AS (
            SELECT q_id, count(*) AS n, max(dense_score) AS ds, max(coverage) AS cv,
                   bool_or(coverage >= 6e-1 AND coalesce(len(matched_terms), 0) >= 2 AND dense_score >= 7e-1 * 35e-2) AS lp FROM cand GROUP BY q_id)
        SELECT q.item_id AS q_id, coalesce(n, 0) AS n_candidates, coalesce(ds, 0e0) AS max_dense_score, coalesce(cv, 0e0) AS max_lexical_coverage, coalesce(lp, false) AS lexical_pass,
               coalesce(ds >= 35e-2, false) AS dense_pass, coalesce(ds >= 35e-2, false) OR coalesce(lp, false) AS passed,
               CASE WHEN n IS NULL THEN 'no_candidates' WHEN NOT (ds >= 35e-2 OR lp) THEN 'below_relevance_gate' ELSE '' END AS refusal_reason
        FROM (SELECT item_id FROM benchmark JOIN embeddings ON vec_id = item_id) q LEFT JOIN g ON g.q_id = q.item_id""",
    "document_filter_topk": f"WITH {duck.bm25()}, sel AS (SELECT h.*, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS lexical_rank FROM hits h SEMI JOIN (SELECT doc_id FROM documents WHERE source IN {duck.listed(SOURCES)}) a USING (doc_id)) SELECT item_id, doc_id, score, lexical_rank FROM sel WHERE lexical_rank <= 10",
    "document_filter_dense": f"""WITH ds AS (
            SELECT a.vec_id AS q_id, b.vec_id, {duck.UNIT_DOT} AS dense_score
            FROM embeddings a JOIN benchmark ON item_id = a.vec_id JOIN embeddings b ON a.vec_id <> b.vec_id SEMI JOIN (SELECT doc_id FROM documents WHERE source IN {duck.listed(SOURCES)}) s ON s.doc_id = b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dense_score DESC, vec_id) AS dense_rank FROM ds)
        SELECT q_id, vec_id, dense_score, dense_rank FROM r WHERE dense_rank <= 10""",
    "ablation_presets": f"""WITH {_CANDIDATES},
        runs AS (SELECT 'dense' AS preset, q_id, doc_id FROM d WHERE dense_rank <= 4 UNION ALL SELECT 'hybrid', q_id, doc_id FROM ranked WHERE fusion_rank <= 4),
        names AS (SELECT * FROM (VALUES ('dense', false, false), ('hybrid', true, false), ('hybrid_rerank', true, true)) t(preset, use_hybrid, use_rerank))
        SELECT preset, use_hybrid, use_rerank, count(DISTINCT q_id) AS n_questions, count(doc_id) AS n_contexts, count(DISTINCT doc_id) AS n_documents
        FROM names LEFT JOIN runs USING (preset) GROUP BY ALL""",
    "preset_metrics": f"""WITH {_CANDIDATES},
        qs AS (SELECT item_id AS q_id, lower(b.text) AS q_text FROM benchmark b JOIN embeddings ON vec_id = item_id),
        scored AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY q_id) > 1 THEN coverage * 10 END AS rs FROM cand),
        rr AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY rs DESC NULLS LAST, fusion_rank) AS rk FROM scored WHERE rs IS NULL OR rs >= 4),
        runs AS (SELECT 'dense' AS preset, q_id, doc_id, dense_rank AS rk FROM d UNION ALL SELECT 'hybrid', q_id, doc_id, fusion_rank FROM ranked UNION ALL SELECT 'hybrid_rerank', q_id, doc_id, rk FROM rr),
        g AS (SELECT preset, q_id, count(*) AS n, coalesce(max(CASE WHEN q_text <> '' AND contains(lower(t.text), q_text) THEN 1e0 / rk END), 0e0) AS rr
              FROM runs JOIN qs USING (q_id) LEFT JOIN documents t USING (doc_id) WHERE rk <= 4 GROUP BY ALL),
        names AS (SELECT unnest(['dense', 'hybrid', 'hybrid_rerank']) AS preset)
        SELECT preset, (SELECT count(*) FROM qs) AS n_questions, count(q_id) AS n_answered, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_contexts, count(*) FILTER (rr > 0) AS n_hit,
               round(coalesce(sum(rr), 0e0) / (SELECT count(*) FROM qs), 6) AS mrr
        FROM names LEFT JOIN g USING (preset) GROUP BY preset""",
}
