"""The ordered folds against recursive SQL, on documents full of headings, bullets, hyphens and long lines."""

import random

import duckdb

from foliospark.operators import chunks
from foliospark.plans import ORACLE_SQL, QUERIES

HEADS = ["BAB {n} RUANG", "BAGIAN {n}", "LAMPIRAN {n}", "Pasal {n} Jadwal", "{n}.2 Alur", "B. Peralatan", "TATA TERTIB UMUM", "JADWAL DAN RUANG", "C. ALUR KERJA"]


def line(rng):
    kind = rng.random()
    if kind < 0.12:
        return rng.choice(HEADS).format(n=rng.randrange(1, 9))
    if kind < 0.2:
        return f"{rng.choice(['-', '•', '1.', 'a)'])} butir {rng.randrange(99)} yang singkat"
    if kind < 0.25:
        return " ".join(f"Kalimat {rng.randrange(999)} panjang dan berisi{rng.choice('.!?;')}" for _ in range(rng.randrange(30, 120)))
    words = " ".join(rng.choice(["mesin", "dan", "ruang", "kerja", "yang", "alat", "Ujung", "lama"]) for _ in range(rng.randrange(1, 25)))
    return words + rng.choice(["", "", ".", "-", ":", ","])


def test_chunks_equal_recursive_sql(spark, tmp_path):
    rng = random.Random(31)
    rows = []
    for d in range(240):
        text = None if d % 41 == 7 else "\n".join(line(rng) if rng.random() > 0.05 else "  " for _ in range(rng.randrange(0, 14)))
        rows.append((d, text, "id", f"buku{d % 4}.pdf", len(text or "")))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("chunk_documents", "chunk_stats", "corpus_summary", "build_stats", "source_documents", "chunk_sections", "explorer_search"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr), name
    assert QUERIES["chunk_sections"](spark, str(tmp_path)).count() > 20 and QUERIES["chunk_stats"](spark, str(tmp_path)).first()["max_pages"] >= 3


def test_documents_stay_whole_under_adaptive_joins(spark, tmp_path):
    """A join that adaptive execution turns into a broadcast reads its shuffle locally; documents must not fall apart."""
    rng = random.Random(7)
    rows = [(f"buku{d}", page, no, line(rng)) for d in range(3) for page in range(1, 61) for no in range(4)]
    rng.shuffle(rows)
    shape = "source_document string, page long, line_no long, line string"
    spark.createDataFrame(rows, shape).repartition(8).write.parquet(str(tmp_path / "lines"))
    held = {"spark.sql.autoBroadcastJoinThreshold": "10", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held |= {"spark.sql.shuffle.partitions": "3", "spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = chunks.chunk_lines(spark.read.parquet(str(tmp_path / "lines")), min_size=1, drop_noise=False).select("source_document", "text", "page_numbers").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = [(d, c["text"], c["pages"]) for d in sorted({r[0] for r in rows}) for c in chunks.pack(chunks.blocks_of([(p, t) for s, p, _, t in sorted(rows) if s == d]))]
    assert sorted(map(tuple, got)) == sorted(want)
