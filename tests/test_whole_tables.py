"""Queries that run the line and answer rules over whole tables."""

from foliospark.plans import QUERIES


def docs(spark, tmp_path, texts):
    rows = [(i, t, "id", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


PAGE_NUMBERS = ("31", "Halaman 2", "hal. 9", "- 60 -", "xvii", "mild")
GLYPHS = ("(cid:8)(cid:1)", "lihat (cid:5) itu")
HEADINGS = {"BAB II PERALATAN": (0, True), "Bagian 6 Gudang": (0, True), "LAMPIRAN C": (0, True), "Pasal 3 Jam buka": (1, False), "5.1 Alur kerja": (2, False), "5.1.4 Rinci": (2, False), "D. Aturan": (2, False), "TATA TERTIB": (0, False), "RUANG (BARAT)": (0, False)}
PLAIN = ("Halaman muka", "1998 07", "d. aturan", "QWZR).", "NO. NAMA ALAT", "TERPOTONG /", "RUANG 7 TIMUR", "QA", "Baris biasa saja.")


def test_line_rules_over_documents(spark, tmp_path):
    every = [*PAGE_NUMBERS, *GLYPHS, *HEADINGS, *PLAIN]
    sf = docs(spark, tmp_path, ["\n".join(every), "isi biasa", "BAB V PENUTUP\nisi"])
    found = {(r["page"], r["line"]): (r["level"], r["structural"]) for r in QUERIES["document_headings"](spark, sf).collect()}
    assert found == {(1, line): v for line, v in HEADINGS.items()} | {(3, "BAB V PENUTUP"): (0, True)}
    assert {r["line"] for r in QUERIES["document_page_numbers"](spark, sf).collect()} == set(PAGE_NUMBERS)
    assert {r["line"] for r in QUERIES["document_glyph_lines"](spark, sf).collect()} == set(GLYPHS)


def test_answer_rules_over_conversations(spark, tmp_path):
    rows = [(1, 1, "user", "Halaman 9"), (1, 2, "assistant", "Isi (Halaman 1).\nSumber: A, Halaman 1"), (1, 3, "assistant", "Halaman 1-4"), (1, 4, "assistant", '[{"id": 3, "score": 6}]'), (2, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["conv_id"], r["turn"]): tuple(r)[2:] for r in QUERIES["conversation_answers"](spark, str(tmp_path)).collect()}
    assert got == {
        (1, 2): ("1", True, 1.0, "", "Isi (Halaman 1).", 0),
        (1, 3): ("1,2,3,4", False, 0.5, "citation_outside_context", "Halaman 1-4", 0),
        (1, 4): ("", False, 0.0, "missing_page_citation", '[{"id": 3, "score": 6}]', 1),
        (2, 1): ("", False, 0.0, "empty_response", None, 0),
    }


def test_every_preset_is_run(spark):
    got = {r["preset"]: r for r in QUERIES["preset_metrics"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == {"dense", "hybrid", "hybrid_rerank"}
    assert all(r["n_answered"] > 0 and r["n_contexts"] > 0 for r in got.values())
    assert got["hybrid_rerank"]["mrr"] >= got["hybrid"]["mrr"]


def test_cards_come_from_the_search(spark, tmp_path):
    """The best document has another id remainder than the item."""
    sf = docs(spark, tmp_path, ["isi lain", "kurikulum beban studi", "beban"])
    spark.createDataFrame([(0, "kurikulum beban studi")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [tuple(r)[:4] for r in QUERIES["retrieved_source_cards"](spark, sf).collect()]
    assert got == [(0, 1, "s", "2,3")]
