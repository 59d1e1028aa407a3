"""The question pipeline, ingestion jobs and evaluation on small inputs of our own."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.functions.constants import RetrievalConfig
from foliospark.operators import answers, chunks, dense, evaluate, fusion, ingestion, lexical, pipeline
from foliospark.sources import files, providers

DOCS = [
    (0, "alat", "Palu godam dipinjam paling lama tiga hari kerja di gudang barat."),
    (1, "alat", "Bor listrik wajib dikembalikan bersama kabel dan kotaknya."),
    (2, "ruang", "Ruang las dibuka pukul delapan sampai pukul empat sore."),
    (3, "ruang", "Ruang bubut memakai kunci yang diambil di pos jaga."),
]


def corpus(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, source_document string, text string")
    rows = docs.select("doc_id", "source_document", F.array(F.col("doc_id") + 1).alias("page_numbers"), (F.col("doc_id") + 1).cast("string").alias("page_label"), F.lit("").alias("section_title"), "text")
    vectors = spark.createDataFrame([(i, [1.0 if i == k else 0.1 for k in range(4)]) for i in range(4)], "doc_id long, embedding array<double>")
    return pipeline.Corpus(lexical.build_stored(docs), vectors, rows)


def asked(spark, rows):
    """(id, query, history, vector position)."""
    data = [(100 + i, q, [(n, r, t) for n, (r, t) in enumerate(h)], any(r == "assistant" for r, _ in h), [1.0 if v == k else 0.0 for k in range(4)]) for i, (q, h, v) in enumerate(rows)]
    return spark.createDataFrame(data, "q_id long, query string, history array<struct<turn:bigint,role:string,text:string>>, has_assistant boolean, q_vec array<double>")


TALK = [("user", "Palu godam"), ("assistant", "Ada di gudang.")]


def run(spark, rows, cfg=RetrievalConfig(), **kw):
    kw = {"rewriter": providers.OfflineRewriter(), "reranker": providers.OfflineReranker()} | kw
    return pipeline.retrieve(asked(spark, rows), corpus(spark), cfg, **kw)


def test_contexts_and_refusals(spark):
    out = run(spark, [("palu godam dipinjam gudang", [], 0), ("resep nasi goreng pedas", [], 2)], RetrievalConfig(dense_threshold=0.9))
    v = {r["q_id"]: r for r in out.verdicts.collect()}
    assert not v[100]["refused"] and v[100]["rerank_pass"] is True
    assert v[101]["refused"] and v[101]["refusal_reason"] == pipeline.BELOW_RERANK and v[101]["rerank_pass"] is False
    first = out.contexts.filter("q_id = 100 and final_rank = 1").first()
    assert first["doc_id"] == 0 and not out.contexts.filter("q_id = 101").count()


def test_rerank_failure_is_no_success(spark):
    """No usable score: fusion order goes on, the gate claims nothing."""
    out = run(spark, [("palu godam", [], 0)], reranker=lambda prompt, system="", json_mode=False: "maaf")
    v = out.verdicts.first()
    assert v["rerank_failed"] and v["rerank_pass"] is None and not v["refused"] and out.contexts.count() == 4
    assert [r["rerank_score"] for r in out.contexts.collect()] == [None] * 4


def test_without_reranker_or_hybrid(spark):
    v = run(spark, [("palu", [], 1)], RetrievalConfig(use_rerank=False, use_hybrid=False))
    assert v.verdicts.first()["rerank_pass"] is None and not v.verdicts.first()["refused"]
    assert v.contexts.orderBy("final_rank").first()["doc_id"] == 1 and v.candidates.filter("lexical_rank is not null").count() == 0


def test_rewriting_uses_history_only_where_needed(spark):
    rows = [("Berapa lama itu?", TALK, 0), ("Berapa lama itu?", [], 0), ("Ruang las dibuka pukul berapa saja setiap hari kerja", TALK, 2)]
    got = {r["q_id"]: (r["effective_query"], r["was_rewritten"]) for r in run(spark, rows).verdicts.collect()}
    assert got == {100: ("Palu godam Berapa lama itu?", True), 101: ("Berapa lama itu?", False), 102: (rows[2][0], False)}

    def broken(prompt, system="", json_mode=False):
        from foliospark.sources.providers import ProviderError

        raise ProviderError("HTTP 401")

    assert [r["effective_query"] for r in run(spark, rows[:1], rewriter=broken).verdicts.collect()] == [rows[0][0]]


def test_document_filter(spark):
    cfg = RetrievalConfig(document_filter=("ruang",), use_rerank=False)
    assert {r["doc_id"] for r in run(spark, [("palu ruang", [], 0)], cfg).candidates.collect()} == {2, 3}
    docs = corpus(spark).chunks
    assert fusion.allowed_documents(docs, RetrievalConfig()) is None
    assert fusion.allowed_documents(docs, RetrievalConfig(document_filter=("alat", "ruang"))) is None


def test_chat_turns(spark):
    rows = [("palu godam dipinjam gudang", [], 0), ("resep nasi goreng pedas sekali", [], 2), ("palu godam", TALK, 0)]
    questions, found = asked(spark, rows), run(spark, rows, RetrievalConfig(dense_threshold=0.9))
    limits = spark.createDataFrame([(100, True, 0), (101, True, 0), (102, False, 60)], "q_id long, allowed boolean, retry_after long")
    got = {r["q_id"]: r for r in pipeline.chat_turns(questions, found, providers.OfflineAnswerer(), limits).collect()}
    assert got[100]["status"] == "answered" and list(got[100]["cited_pages"]) == [1] and got[100]["n_cards"] == 1 and "Sumber" not in got[100]["display"]
    assert got[101]["status"] == "refused" and answers.no_context_answer() == got[101]["display"]
    assert got[102]["status"] == "rate_limited" and got[102]["display"] == ""


def test_answer_prompt_quotes_history(spark):
    contexts = spark.createDataFrame([(1, "apa?", 1, "Buku", "3", "", "isi")], "q_id long, query string, final_rank long, document_label string, page_label string, section_title string, text string")
    histories = spark.createDataFrame([(1, [(n, "user" if n % 2 else "assistant", f"pesan {n}") for n in range(9)])], "q_id long, history array<struct<turn:bigint,role:string,text:string>>")
    prompt = answers.answer_prompts(contexts, histories=histories).first()["prompt"]
    assert "pesan 2" not in prompt and "Pengguna: pesan 3" in prompt and prompt.index("pesan 8") < prompt.index("Pertanyaan: apa?")


def test_cited_contexts(spark):
    rows = spark.createDataFrame([(1, [1, 2], [2]), (2, [3], [2]), (3, [4], [])], "n int, page_numbers array<int>, cited_pages array<int>")
    assert {r["n"]: r["page_numbers"] for r in answers.cited_contexts(rows).collect()} == {1: [2], 3: [4]}


def test_scored_questions_and_answers(spark, tmp_path):
    rows = [("palu godam dipinjam gudang", [], 0), ("resep nasi goreng pedas sekali", [], 2)]
    questions = asked(spark, rows).join(spark.createDataFrame([(100, "in_scope", False, [1], ["palu", "Gudang"]), (101, "out_of_scope", False, [], [])], "q_id long, category string, is_conversational boolean, expected_pages array<long>, expected_keywords array<string>"), "q_id")
    found = run(spark, rows, RetrievalConfig(dense_threshold=0.9))
    got = {r["q_id"]: r for r in evaluate.score_questions(questions, found).collect()}
    assert got[100]["page_hit"] and got[100]["reciprocal_rank"] == 1.0 and got[100]["keyword_hit"] and not got[101]["keyword_hit"] and got[101]["refused"]
    generated = pipeline.generate(questions, found, providers.OfflineAnswerer())
    judged = {r["q_id"]: r for r in evaluate.score_answers(questions, found, generated, providers.OfflineJudge()).collect()}
    assert judged[100]["citation_valid"] and judged[100]["cites_expected_page"] and judged[100]["groundedness_score"] >= 7 and judged[100]["grounded"]
    assert judged[101]["refused_by_retrieval"] and judged[101]["groundedness_score"] is None and not judged[101]["judge_failed"]

    def down(prompt, system="", json_mode=False):
        from foliospark.sources.providers import ProviderError

        raise ProviderError("HTTP 401: no")

    failed = evaluate.score_answers(questions, found, pipeline.generate(questions, found, down), providers.OfflineJudge()).filter("q_id = 100").first()
    assert failed["generation_failed"] and failed["groundedness_score"] is None and not failed["has_citation"]
    scored = evaluate.score_questions(questions, found).withColumns({"preset": F.lit("hybrid"), "latency_ms": F.lit(2.0)})
    metrics = evaluate.retrieval_metrics(scored)
    full = evaluate.save_run(scored, metrics, str(tmp_path / "run"))
    part = evaluate.save_run(scored.limit(1), metrics, str(tmp_path / "run"), partial=True)
    assert full != part and spark.read.json(f"{full}/results").count() == 2 and spark.read.json(f"{part}/results").count() == 1
    assert {r["metric"]: r["hybrid"] for r in evaluate.compare(metrics).collect()}["page_recall"] == 1.0


def test_question_selection_and_timings(spark):
    rows = spark.createDataFrame([(3, "in_scope", True), (1, "in_scope", False), (2, "out_of_scope", False)], "q_id long, category string, is_conversational boolean")
    assert [r["q_id"] for r in evaluate.select_questions(rows, limit=2).collect()] == [1, 2]
    assert [r["q_id"] for r in evaluate.select_questions(rows, "in_scope", conversational=True).collect()] == [3]
    assert evaluate.force_rewrite(rows, False) and not evaluate.force_rewrite(rows.filter("q_id < 3"), False)
    total = spark.createDataFrame([({"a": 1.5, "b": 2.0},), ({},)], "t map<string,double>").select(evaluate.total_ms(F.col("t")).alias("t"))
    assert sorted(r["t"] for r in total.collect()) == [0.0, 3.5]


def test_question_file(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"id": 4, "question": "apa?", "expected_pages": [2]}, {"id": 5, "question": "lalu?", "category": "out_of_scope", "chat_history": [{"role": "assistant", "content": "x"}]}]))
    got = {r["q_id"]: r for r in files.load_questions(spark, str(path)).collect()}
    assert got[4]["category"] == "in_scope" and list(got[4]["expected_pages"]) == [2] and not got[4]["is_conversational"] and got[5]["has_assistant"] and got[5]["history"][0]["text"] == "x"
    with pytest.raises(FileNotFoundError):
        files.load_questions(spark, str(tmp_path / "none.json"))


def pages(spark):
    rows = [("a.pdf", p, "\n".join(f"Kalimat {n} tentang alat yang dipakai dan disimpan di ruang {p}." for n in range(12))) for p in (1, 2)] + [("kosong.pdf", 1, "12\n--"), ("b.pdf", 1, "12\n" + "Isi yang cukup panjang untuk satu potongan dan masih ditambah lagi agar lolos batas paling kecil. " * 3)]
    return spark.createDataFrame(rows, "source_document string, page long, text string")


def test_ingestion(spark, tmp_path):
    prints = spark.createDataFrame([("a.pdf", "p", 10, "aa"), ("b.pdf", "p", 20, "bb"), ("kosong.pdf", "p", 1, "cc")], "name string, path string, length long, sha256 string")
    target = str(tmp_path / "index")
    records = {r["name"]: r for r in ingestion.run_ingestion(spark, pages(spark), prints, providers.HashEmbedder(8), target, dry_run=True).collect()}
    assert set(records) == {"a.pdf", "b.pdf"} and records["b.pdf"]["dropped"] == {"page_number": 1} and records["b.pdf"]["lines_raw"] == 2 and not files.exists(spark, target)
    ingestion.run_ingestion(spark, pages(spark), prints, providers.HashEmbedder(8), target)
    vectors, made = files.load_index(spark, target)
    assert vectors.count() == made.count() > 2 and {r["source_document"] for r in made.collect()} == {"a.pdf", "b.pdf"}
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in vectors.collect())
    info = files.load_manifest(spark.read.text(f"{target}/provenance").first()["value"])
    assert files.manifest(info) == [("a.pdf", "aa"), ("b.pdf", "bb")]
    with pytest.raises(FileExistsError):
        ingestion.run_ingestion(spark, pages(spark), prints, providers.HashEmbedder(8), target)
    with pytest.raises(ValueError, match="no document"):
        ingestion.run_ingestion(spark, pages(spark).filter("source_document = 'kosong.pdf'"), prints, providers.HashEmbedder(8), str(tmp_path / "x"))
    with pytest.raises(ValueError, match="vectors for"):
        ingestion.run_ingestion(spark, pages(spark), prints, lambda texts, task="document": [[] for _ in texts], str(tmp_path / "y"))


def test_explorer(spark):
    rows = spark.createDataFrame([(i, f"isi {i} a.b", "Judul" if i % 2 else "") for i in range(120)] + [(200, "axb", "")], "chunk_index long, text string, section_title string")
    assert chunks.explore(rows, "A.B").count() == 50 and chunks.explore(rows, "judul", 5).first()["chunk_index"] == 1
    assert chunks.explore(rows.filter("chunk_index >= 119"), "a.b").count() == 1 and chunks.explore(rows).count() == 50


def test_health():
    assert providers.health(lambda prompt, system="", json_mode=False: prompt) and not providers.health(lambda prompt, system="", json_mode=False: "halo")

    def down(prompt, system="", json_mode=False):
        raise providers.ProviderError("HTTP 500")

    assert not providers.health(down)


def test_half_even(spark):
    values = [2.675, 2.665, 0.125, 0.375, 2.5, -1.005, 1234.565, 0.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(text.half_even(F.col("v"), 2).alias("r"))
    assert [r["r"] for r in got.collect()] == [round(v, 2) for v in values]


def test_compatibility_forms(spark):
    import re
    import unicodedata

    samples = ["Bab Ⅳ", "№ 5", "Merk™", "ĳs", "½ jam", "10 ㎏", "x²", "ﬁsika", "a᷀b", "⑫", "Ǆ", "café ①", "ﷺ", "𝐀𝐛𝟗", "K", "…", "„kutip“"]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    got = spark.createDataFrame(list(enumerate(samples)), "i long, t string").select("i", text.normalize(F.col("t")).alias("n")).collect()
    assert {r["i"]: re.findall("[a-z0-9]+", r["n"]) for r in got} == {i: re.findall("[a-z0-9]+", plain(t)) for i, t in enumerate(samples)}


def test_dense_filter_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "q_id long, q_vec array<double>")
    got = {(r["q_id"], r["dense_rank"]): r["vec_id"] for r in dense.top_k(dense.scores(q, v, 4), 4).collect()}
    cos = lambda a, b: round((a[0] * b[0] + a[1] * b[1]) / ((a[0] ** 2 + a[1] ** 2) ** 0.5 * (b[0] ** 2 + b[1] ** 2) ** 0.5), 6)
    for i in range(7):
        best = sorted(range(40), key=lambda k: (-cos([1.0, float(i)], [float(k % 5), 1.0]), k))[:4]
        assert [got[i, n + 1] for n in range(4)] == best
    some = spark.createDataFrame([(k,) for k in range(30, 40)], "doc_id long")
    assert {r["vec_id"] for r in dense.scores(q, v, 4, allowed=some).collect()} <= set(range(30, 40))
