"""Searches of many questions: results, and plans that do not grow with the questions."""

import random

from foliospark.operators import dense, lexical, pipeline
from foliospark.plans import chat


def plan(df):
    return df._jdf.queryExecution().toString()


def test_lexical_rounds_agree_with_the_join(spark, monkeypatch):
    """Few questions a block and a round, some terms as matrices; equal documents tie by id."""
    rng = random.Random(3)
    words = [f"w{i}x" for i in range(30)]
    texts = [" ".join(rng.choices(words, range(30, 0, -1), k=rng.randrange(1, 25))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:9], "", "yang"])), "doc_id long, text string")
    questions = spark.createDataFrame([(100 + i, t) for i, t in enumerate([*texts[:17], "", "tanpa w1x w1x", "kosong"])], "item_id long, text string")
    index = lexical.build_stored(docs)
    for name, value in (("ROUND", 5), ("QUESTIONS", 3), ("DOCUMENTS", 8), ("FREQUENT", 4)):
        monkeypatch.setattr(lexical, name, value, raising=False)
    got = lexical.best(questions, index, 6)
    want = lexical.top_hits(lexical.bm25(questions, index), 6)
    columns = ["item_id", "doc_id", "score", "coverage", "lexical_rank"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert "Union" not in plan(got)


def test_dense_rounds_search_equal_vectors_once(spark, monkeypatch):
    vectors = [[float(i % 7), 1.0, float(i % 3)] for i in range(40)]
    v = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, vectors[i % 20]) for i in range(50)], "q_id long, q_vec array<double>")
    whole = {tuple(r) for r in dense.top_k(dense.scores(q, v, None, exclude_self=True), 5).collect()}
    for name, value in (("ROUND", 4), ("QUERY_BLOCK", 2), ("VECTOR_ROWS", 6)):
        monkeypatch.setattr(dense, name, value, raising=False)
    scored = dense.scores(q, v, 5, exclude_self=True)
    assert {tuple(r) for r in dense.top_k(scored, 5).collect()} == whole and len(whole) == 250
    assert not any(r["q_id"] == r["vec_id"] for r in scored.collect())
    assert "Union" not in plan(scored)


def test_presets_share_one_search(spark, monkeypatch):
    """Three presets, one rewrite and one search."""
    calls = []
    monkeypatch.setattr(chat, "_asked", lambda spark, sf: None)
    monkeypatch.setattr(chat, "corpus", lambda spark, sf: None)
    monkeypatch.setattr(pipeline, "search", lambda *a: calls.append(a) or "lists", raising=False)
    monkeypatch.setattr(pipeline, "retrieve", lambda *a, searched=None, **k: searched)
    assert [chat.outcome(spark, "nowhere", name) for name in chat.PRESETS] == ["lists"] * 3
    assert len(calls) == 1


def test_rewriting_searches_nothing(spark, monkeypatch):
    """The rewritten questions come without an outcome and equal those that a search uses."""
    sf = "/root/testdata/sf0.001"
    rows = {tuple(r) for r in chat.outcome(spark, sf).verdicts.select("q_id", "effective_query", "was_rewritten").collect()}
    monkeypatch.setattr(chat, "outcome", lambda *a: (_ for _ in ()).throw(AssertionError("searched")))
    got = [tuple(r) for r in chat.rewritten_queries(spark, sf).collect()]
    assert set(got) == rows and len(got) == len(rows) and any(r[2] for r in got)


def test_compressed_tables_are_not_collected_for_a_broadcast(spark):
    """Written rows compress so well that Spark takes a large table for a small one; the driver would hold its rows."""
    sf = "/root/testdata/sf0.001"
    found = chat.outcome(spark, sf)
    frames = [chat.final_contexts(spark, sf), chat.debug_candidates(spark, sf), chat.score_questions(spark, sf), chat.cited_source_cards(spark, sf), found.contexts, found.candidates]
    assert [i for i, df in enumerate(frames) if "BroadcastHashJoin" in df._jdf.queryExecution().sparkPlan().toString()] == []
