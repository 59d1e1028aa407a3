"""The index in one pass over the texts, and searches that begin with a bound of each question."""

import random

from foliospark.functions.text import normalize, normalized, tokens
from foliospark.operators import lexical
from foliospark.plans import chat
from pyspark.sql import functions as F

TEXTS = ["Mata Kuliah: Skripsinya di Prodi IV, 2024 dan buku-bukumu", "Über die ﬁnanz ½ Ｋ K Ⅻ résumé naïve İstanbul №7 ǅ", "", None, "a b yang 7 07 mk Matkul matakuliahnya", "tugas  akhir\ttugas akhir x́y éte"]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_one_pass_index_equals_the_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    built, plain = lexical.build_stored(docs), lexical.build(docs)
    assert "Exchange" not in built.tf._jdf.queryExecution().sparkPlan().toString() and "Generate" in built.tf._jdf.queryExecution().sparkPlan().toString()
    assert rows(built.tf, "doc_id", "term", "tf") == rows(plain.tf, "doc_id", "term", "tf") == rows(tokens(docs, "text", "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("tf")), "doc_id", "term", "tf")
    assert rows(built.lengths, "doc_id", "dl") == rows(plain.lengths, "doc_id", "dl") and rows(built.df, "term", "df") == rows(plain.df, "term", "df")
    assert built.corpus.first() == plain.corpus.first()
    want = docs.filter("text is not null").select("text", normalize(F.col("text")).alias("n")).collect()
    assert [normalized(r["text"]) for r in want] == [r["n"] for r in want]


def test_rows_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "w1x w2x"), (1, "w2x"), (2, "w3x"), (None, "w1x")], "doc_id long, text string")
    built, plain = lexical.build_stored(docs), lexical.build(docs)
    key = ("term", "tf")
    assert sorted(rows(built.tf.filter("doc_id is not null"), "doc_id", *key)) == rows(plain.tf.filter("doc_id is not null"), "doc_id", *key)


def test_bounds_of_some_documents_lose_nothing(spark, monkeypatch):
    """Some documents are scored first, in several tasks; equal documents tie by id, and few questions have enough of them."""
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(40)]
    texts = [" ".join(rng.choices(words, range(40, 0, -1), k=rng.randrange(1, 30))) for _ in range(90)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:25], ""])), "doc_id long, text string")
    questions = spark.createDataFrame([(500 + i, t) for i, t in enumerate([*texts[:21], "", "w39x", "w0x w0x w39x", "kosong"])], "item_id long, text string")
    index = lexical.build_stored(docs)
    firsts = []
    kept = lexical._bounds
    monkeypatch.setattr(lexical, "_bounds", lambda *a: firsts.append(a) or kept(*a))
    for name, value in (("ROUND", 7), ("QUESTIONS", 3), ("DOCUMENTS", 8), ("FREQUENT", 4), ("FIRST", 30), ("FIRST_TASKS", 2)):
        monkeypatch.setattr(lexical, name, value)
    columns = ["item_id", "doc_id", "score", "coverage", "lexical_rank"]
    assert rows(lexical.best(questions, index, 5), *columns) == rows(lexical.top_hits(lexical.bm25(questions, index), 5), *columns)
    assert firsts


def test_copies_are_searched_once(spark, monkeypatch):
    """Of equal documents and of questions with equal terms one is searched; each question still gets the least ids of all copies."""
    docs = spark.createDataFrame([(i, ("w1x w2x", "w2x w1x", "w1x w3x w3x", "w2x", "")[i % 5]) for i in range(40)], "doc_id long, text string")
    questions = spark.createDataFrame([(100 + i, ("w1x w2x", "w2x w1x", "w3x w3x", "w3x", "w9x")[i % 5]) for i in range(20)], "item_id long, text string")
    index = lexical.build_stored(docs)
    searched = []
    kept = lexical._asked
    monkeypatch.setattr(lexical, "_asked", lambda entries, n: searched.extend(entries["q"].to_pylist()) or kept(entries, n))
    got = rows(lexical.ranked(questions, index, 11), "item_id", "doc_id", "score", "lexical_rank")
    assert got == rows(lexical.top_hits(lexical.bm25(questions, index), 11), "item_id", "doc_id", "score", "lexical_rank")
    assert set(searched) == {100, 102, 103}


def test_items_are_found_inside_words_and_across_lines(spark):
    """Only the inner words of an item have to be words of the text."""
    texts = spark.createDataFrame([(1, b"xone two\nthreey"), (2, b"one two three"), (3, b"one twothree"), (4, b"a two b"), (5, None), (6, "über one two three".encode())], "doc_id long, t binary")
    items = spark.createDataFrame([(10, b"one two\nthree"), (11, b"two"), (12, b"ne tw"), (13, b" two "), (14, b"one two three")], "q_id long, q binary")
    pairs = [(q, d) for q, part in items.collect() for d, t in texts.collect() if t is not None and bytes(part) in bytes(t)]
    assert rows(chat._holding(texts, items), "q_id", "doc_id") == sorted(pairs) and len(pairs) == 13
