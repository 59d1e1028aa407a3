import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.operators import answers
from foliospark.sources import files, providers
from foliospark.streaming import limiter


def test_scores_and_verdicts():
    assert answers.scores_of('x [{"id": 2, "score": "7"}] y', 2) == {2: 7.0}
    assert answers.scores_of('[{"id": 1, "score": NaN}]', 2) == {} and answers.scores_of(None, 2) == {}
    assert answers.verdict_of('```json\n{"score": 12, "unsupported_claims": ["a"]}\n```') == (10.0, ["a"], False)
    assert answers.verdict_of("rusak") == (None, [], True)


def test_sanitized_rewrites(spark):
    cases = [('"Apa syarat cuti?"', "Apa syarat cuti?"), ("Query: Apa itu KRS?\nlain", "Apa itu KRS?"), ("  \n ", "asal"), ("x" * 300, "asal"), (None, "asal")]
    df = spark.createDataFrame([(a, "asal", b) for a, b in cases], "raw string, q string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", answers.sanitize_rewrite(F.col("raw"), F.col("q"))).collect())


def test_prompts(spark):
    c = spark.createDataFrame([(1, "apa?", 2, "b  b"), (1, "apa?", 1, "a"), (2, "x", 1, "z")], "q_id long, query string, fusion_rank long, text string")
    got = answers.rerank_prompts(c).collect()
    assert len(got) == 1 and "[1] a\n\n[2] b b" in got[0]["prompt"]
    ctx = spark.createDataFrame([(1, "apa?", 1, "Buku", "3", "", "isi"), (1, "apa?", 2, "Buku", "3", "", "lain")], "q_id long, query string, final_rank long, document_label string, page_label string, section_title string, text string")
    assert answers.answer_prompts(ctx).first()["prompt"].count("- Buku, Halaman 3") == 1


def test_limiter_rules():
    state = (None, 0)
    out = []
    for now in (100.0, 101.0, 102.0, 161.0):
        start, used, ok, retry = limiter.consume(*state, now, 2, 10)
        state = (start, used)
        out.append((ok, used, retry))
    assert out == [(True, 1, 0), (True, 2, 0), (False, 2, 58), (True, 1, 0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, i, 1000.0 + 400 * i) for i in range(40) for u in (i % 3,)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, now double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    pytest.importorskip("google.protobuf")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = limiter.streaming_rate_limit(stream, 3, 3600).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = limiter.rate_limit(df.withColumn("ts", F.timestamp_seconds("now")), 3, 3600)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("limited")) == key(batch)


def test_files_and_freshness(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"satu")
    (tmp_path / "b.pdf").write_bytes(b"dua")
    (tmp_path / "c.txt").write_bytes(b"tiga")
    listed = files.discover(spark, [str(tmp_path / "b.pdf"), str(tmp_path), str(tmp_path / "a.pdf")])
    assert [(r["ord"], r["name"]) for r in listed.collect()] == [(1, "b.pdf"), (2, "a.pdf")]
    found = files.fingerprints(spark, listed)
    streamed = files.fingerprints(spark, listed, whole=0)
    assert {(r["name"], r["sha256"]) for r in found.collect()} == {(r["name"], r["sha256"]) for r in streamed.collect()} == {("a.pdf", hashlib.sha256(b"satu").hexdigest()), ("b.pdf", hashlib.sha256(b"dua").hexdigest())}
    old = spark.createDataFrame([(r["name"], r["sha256"]) for r in found.collect() if r["name"] == "a.pdf"] + [("z.pdf", "0")], "name string, sha256 string")
    state = files.freshness(old, found)
    assert {r["name"]: r["status"] for r in state.collect()} == {"a.pdf": "unchanged", "b.pdf": "untracked", "z.pdf": "missing"}
    assert files.is_stale(state).first()["is_stale"]
    record = {"pipeline_version": 3, "source_documents": [{"name": r["name"], "sha256": r["sha256"]} for r in found.collect()]}
    assert not files.check_freshness(spark, record, found)["is_stale"]
    older = files.check_freshness(spark, {**record, "pipeline_version": 2}, found)
    assert older["is_stale"] and "pipeline 2" in older["messages"][0]
    assert not files.check_freshness(spark, {}, found)["is_stale"]
    assert files.safe_document_path("a.pdf", str(tmp_path)) and not any(files.safe_document_path(n, str(tmp_path)) for n in ("../a.pdf", "c.txt", "x.pdf", "", "sub/a.pdf"))
    assert files.manifest({"source_pdf": {"name": "a", "sha256": "1"}}) == [("a", "1")] and files.load_manifest("{rusak") == {}


def test_text_pages_and_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text("satu\f \fdua")
    assert [(r["page"], r["text"]) for r in files.text_pages(spark, [str(tmp_path)]).orderBy("page").collect()] == [(1, "satu"), (3, "dua")]
    df = spark.createDataFrame([([["a", None], [None, " "], ["b", "c"]],)], "cells array<array<string>>")
    assert df.select(files.table_text(F.col("cells")).alias("t")).first()["t"] == "a | \nb | c"


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "isi", [1]), (1, "lain", [2, 3])], "chunk_index long, text string, page_numbers array<int>")
    vectors = providers.embed(chunks, "text", providers.HashEmbedder(8)).select("chunk_index", "embedding")
    info = files.index_info(chunks, spark.createDataFrame([("a.pdf", "1")], "name string, sha256 string"), 8, 1400, 250)
    files.save_index(vectors, chunks, info, str(tmp_path / "idx"))
    files.check_in_sync(spark.read.parquet(str(tmp_path / "idx/vectors")), spark.read.parquet(str(tmp_path / "idx/chunks")))
    with pytest.raises(FileExistsError):
        files.save_index(vectors, chunks, info, str(tmp_path / "idx"))
    files.save_index(vectors.limit(1), chunks.limit(1), info, str(tmp_path / "idx"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "idx/chunks")).count() == 1
    with pytest.raises(ValueError):
        files.check_in_sync(vectors.limit(1), chunks)


def test_chat_fallback_and_errors():
    calls = []

    def post(url, payload, headers, timeout):
        calls.append(payload["model"])
        if payload["model"] == "a":
            raise providers.ProviderError("HTTP 404: model not found")
        return {"choices": [{"message": {"content": [{"text": "ha"}, {"text": "lo"}]}}]}

    chat = providers.HttpChat("http://x", "k", ("a", "b"), post=post)
    assert chat("hai") == "halo" and chat("hai") == "halo" and calls == ["a", "b", "b"]
    assert providers.chat_text({"choices": []}) == ""
    tries = []

    def flaky():
        tries.append(1)
        raise providers.ProviderError("HTTP 429")

    with pytest.raises(providers.ProviderError):
        providers.with_retry(flaky, sleep=lambda s: None)
    assert len(tries) == 3


def test_completion_keeps_errors_apart(spark):
    def provider(prompt, system="", json_mode=False):
        from foliospark.sources.providers import ProviderError

        if prompt == "b":
            raise ProviderError("401 bad key")
        return prompt.upper()

    df = spark.createDataFrame([("a",), ("b",)], "p string")
    got = {r["p"]: (r["reply"], r["reply_error"]) for r in providers.complete(df, "p", provider).collect()}
    assert got == {"a": ("A", None), "b": (None, "401 bad key")}


def test_settings(monkeypatch):
    monkeypatch.setenv("X_KEY", "changeme")
    assert providers.setting("X_KEY", secrets={"X_KEY": " s "}) == "s"
    assert providers.setting("X_KEY", explicit="e") == "e" and providers.setting("Y_KEY", default="d") == "d"
    assert pd.Series(providers.HashEmbedder(4)(["a b", ""])[1]).abs().sum() == 0
