import math

from foliospark.functions.constants import RetrievalConfig
from foliospark.operators import dense, fusion, lexical

DOCS = [(0, "krs ipk minimum 144 sks"), (1, "beasiswa prestasi ipk"), (2, "parkir kendaraan kampus"), (3, "")]


def index(spark):
    return lexical.build(spark.createDataFrame(DOCS, "doc_id long, text string"))


def test_corpus_counts_empty_documents(spark):
    row = index(spark).corpus.first()
    assert row["n"] == 4 and row["avgdl"] == (5 + 3 + 3) / 4


def test_bm25_against_the_formula(spark):
    q = spark.createDataFrame([(7, "ipk ipk sks")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in lexical.search(q, index(spark), 9).collect()}
    avgdl, idf = 11 / 4, lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda df, dl: idf(df) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert set(rows) == {0, 1}
    assert abs(rows[0]["score"] - (2 * part(2, 5) + part(1, 5))) < 1e-5
    assert rows[0]["coverage"] == 1.0 and list(rows[0]["matched_terms"]) == ["ipk", "sks"]
    assert abs(rows[1]["coverage"] - idf(2) / (idf(2) + idf(1))) < 1e-5


def test_coverage_of_unknown_terms(spark):
    q = spark.createDataFrame([(7, "ipk kosakata"), (8, "yang")], "item_id long, text string")
    pairs = spark.createDataFrame([(7, 0), (8, 0)], "item_id long, doc_id long")
    rows = {r["item_id"]: r["coverage"] for r in lexical.coverage(q, index(spark), pairs).collect()}
    assert 0 < rows[7] < 0.5 and rows[8] == 0.0


def test_dense_top_k_ties_and_self(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [5.0, 0.0])], "q_id long, q_vec array<double>")
    got = dense.top_k(dense.scores(q, v, 2, exclude_self=True), 2).orderBy("dense_rank").collect()
    assert [(r["vec_id"], r["dense_score"]) for r in got] == [(1, 1.0), (3, 1.0)]
    far = dense.lookup(spark.createDataFrame([(0, 2), (0, 9)], "q_id long, vec_id long"), q, v).orderBy("vec_id").collect()
    assert [r["dense_score"] for r in far] == [0.0, 0.0]


def test_fusion_keeps_both_ranks(spark):
    cfg = RetrievalConfig()
    d = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "q_id long, doc_id long, dense_score double, dense_rank long")
    lx = spark.createDataFrame([(1, 11, 3.0, 1, 0.7, ["a", "b"]), (1, 12, 2.0, 2, 0.2, ["a"])], "q_id long, doc_id long, score double, lexical_rank long, coverage double, matched_terms array<string>")
    rows = {r["doc_id"]: r for r in fusion.fused_top(fusion.candidates(d, lx, cfg), 10).collect()}
    assert rows[11]["fusion_rank"] == 1 and rows[10]["lexical_rank"] is None and rows[12]["dense_rank"] is None
    assert abs(rows[11]["fusion_score"] - (1 / 62 + 1 / 61)) < 1e-9


def gate(spark, rows, **kw):
    c = spark.createDataFrame(rows, "q_id long, dense_score double, coverage double, matched_terms array<string>")
    q = spark.createDataFrame([(1,), (2,)], "q_id long")
    return {r["q_id"]: r for r in fusion.gate(q, c, RetrievalConfig(**kw)).collect()}


def test_gate_branches(spark):
    got = gate(spark, [(1, 0.75, 0.0, None)])
    assert got[1]["passed"] and got[1]["dense_pass"] and got[2]["refusal_reason"] == "no_candidates"
    rescue = gate(spark, [(1, 0.5, 0.6, ["a", "b"]), (2, 0.5, 0.9, ["a"])])
    assert rescue[1]["passed"] and not rescue[1]["dense_pass"] and rescue[2]["refusal_reason"] == "below_relevance_gate"
    assert not gate(spark, [(1, 0.48, 0.9, ["a", "b"])])[1]["passed"]


def test_rerank_gate_is_tri_state(spark):
    rows = [(1, 5.0, True), (1, 1.0, True), (2, 1.0, True), (2, None, True), (3, None, False), (3, None, False), (4, None, True)]
    c = spark.createDataFrame(rows, "q_id long, rerank_score double, rerank_ok boolean")
    got = {r["q_id"]: r["rerank_pass"] for r in fusion.rerank_gate(c, RetrievalConfig()).collect()}
    assert got == {1: True, 2: False, 3: None, 4: None}
