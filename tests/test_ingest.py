from pyspark.sql import functions as F

from foliospark.operators import chunks, lines


def frame(spark, rows):
    return spark.createDataFrame(rows, "source_document string, page long, line_no long, line string")


def test_drop_reasons_in_order(spark):
    rows = [("a", 1, i, t) for i, t in enumerate(["(cid:3) 12", "12", "ab", "UUUNNNIII", "Isi baris", "Isi  baris", "Isi lain"])]
    got = {r["line_no"]: r["drop_reason"] for r in lines.with_reasons(frame(spark, rows)).collect()}
    assert got == {0: "glyph_code", 1: "page_number", 2: "too_short", 3: "gibberish", 4: None, 5: "duplicate", 6: None}


def test_running_header(spark):
    rows = [("a", p, n, t) for p in range(1, 13) for n, t in enumerate([f"Buku Panduan {p}", f"isi halaman yang unik {'abcdefghijkl'[p - 1] * 2}u", "tengah", f"penutup {'qwertyuiopas'[p - 1]}o", f"ekor lain {'zxcvbnmasdfg'[p - 1]}a"])]
    got = [(r["template"], r["n"]) for r in lines.running_templates(frame(spark, rows)).collect()]
    assert got == [("buku panduan #", 12)]
    assert lines.running_templates(frame(spark, rows[:20])).count() == 0


def test_consonant_runs(spark):
    got = spark.range(1).select(*[lines.consonant_run(F.lit(w)).alias(w) for w in ("struktur", "administrasi", "arudtkpu", "aeiou", "YYY")]).first()
    assert got.asDict() == {"struktur": 2, "administrasi": 2, "arudtkpu": 4, "aeiou": 0, "YYY": 3}


def test_clean_pages_leave_out_empty_ones(spark):
    pages = spark.createDataFrame([("a", 1, "12\n--"), ("a", 2, " satu  dua \n\ntiga")], "source_document string, page long, text string")
    assert [(r["page"], r["text"]) for r in lines.clean_pages(pages).collect()] == [(2, "satu dua\ntiga")]


def test_headings():
    assert chunks.heading_of("BAB IV KURIKULUM") == (0, True)
    assert chunks.heading_of("Pasal 12") == (1, False)
    assert chunks.heading_of("3.2 Beban") == (2, False)
    assert chunks.heading_of("SISTEM PENILAIAN") == (0, False)
    for line in ("ABC).", "NO. NAMA MATERI", "JUDUL TERPOTONG /", "KODE 12 ANGKA", "x" * 121, "ABCDE"):
        assert chunks.heading_of(line) is None, line


def test_structural_title_goes_on_once():
    made = chunks.blocks_of([(1, "BAB I"), (1, "PENDAHULUAN"), (1, "TUJUAN UMUM"), (1, "Isi.")])
    assert [b.path for b in made] == [("BAB I PENDAHULUAN",), ("TUJUAN UMUM",), ("TUJUAN UMUM",)]


def test_heading_depth_on_an_empty_stack():
    made = chunks.blocks_of([(1, "A. Umum"), (1, "Pasal 2"), (1, "isi")])
    assert made[-1].path == ("A. Umum", "Pasal 2")


def test_joined_hyphens():
    assert chunks.join_lines(["univer-", "sitas", "Kampus-", "Dua"]) == "universitas Kampus- Dua"


def test_pack_overlap_and_page_cap():
    blocks = [chunks.Block([(p, f"kalimat {p} " + "x" * 60 + ".")]) for p in range(1, 15)]
    made = chunks.pack(blocks, size=10_000)
    assert all(len(c["pages"]) <= 3 for c in made) and sorted(set(sum((c["pages"] for c in made), []))) == list(range(1, 15))
    wide = [chunks.Block([(p, "a" * 50)]) for p in (1, 2, 3)] + [chunks.Block([(4, "b" * 50), (5, "b" * 50)])]
    assert chunks.pack(wide)[-1]["pages"] == [2, 3, 4, 5]
    assert chunks.pack(wide, strict_page_cap=True)[-1]["pages"] == [3, 4, 5]


def test_oversized_blocks_split_by_line_and_sentence():
    block = chunks.Block([(1, "a" * 30), (2, "b" * 30), (3, "Satu dua. Tiga empat. Lima enam tujuh delapan.")])
    parts = chunks.split_block(block, 40)
    assert [p.pages for p in parts] == [{1}, {2}, {3}, {3}] and all(len(p.text) <= 40 for p in parts)


def test_chunks_are_numbered_without_gaps(spark):
    rows = [(d, 1, i, f"Kalimat nomor {i} yang cukup panjang untuk dan dengan isi yang berarti.") for d in ("b", "a") for i in range(60)]
    got = chunks.with_labels(chunks.chunk_lines(frame(spark, rows), size=500)).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and got[0]["source_document"] == "a"
    assert all(r["page_label"] == "1" and r["char_count"] >= 120 for r in got)


def test_noise(spark):
    texts = {"arudtakpu satlukasf": True, "ini dan itu": False, "": True, "kode 12 34 56": False, "kata. lain": False}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunks.looks_like_noise(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == texts


def test_page_ranges(spark):
    df = spark.createDataFrame([(1, [39, 40, 48, 40]), (2, [])], "k long, p array<long>")
    assert {r["k"]: r["page_ranges"] for r in chunks.page_ranges(df, "k", "p").collect()} == {1: "39–40, 48", 2: "-"}
