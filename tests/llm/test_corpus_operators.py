"""Media chunks, near duplicates, repeats, chat format, WARC audit and the pipeline."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import chat, components, media, paragraphs, queries, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "one", "two words", "é" * 700, "x" * 20_000, "x" * 20_000, "🙂 emoji", "A b C", "a B c"]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t) if t else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# ---- media ------------------------------------------------------------------


def brute_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_is_the_rolling_one():
    data = random.Random(1).randbytes(500)
    assert media.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == brute_gear(data)


def test_chunks_follow_content():
    rng = random.Random(2)
    data = rng.randbytes(60_000)
    a, b = media.chunks(data), media.chunks(rng.randbytes(777) + data)
    assert b"".join(c for _, c in a) == data and max(len(c) for _, c in a) <= media.MAX_CHUNK
    assert len({d for d, _ in a} & {d for d, _ in b}) > len(a) / 2
    assert media.load(media.store(a)) == data
    broken = bytearray(media.store(a))
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        media.load(bytes(broken))


def test_media_round_trip(spark):
    rng = random.Random(3)
    shared = " ".join(words(rng, 3000))
    texts = ODD + [shared + f" tail {i}" for i in range(6)] + [f"head {i} " + shared for i in range(6)] + [" ".join(words(rng, 2000)) for _ in range(8)]
    got = {r["doc_id"]: r for r in media.media_features(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    # Brute force: a chunk is in the store if it occurs more than once in the corpus, in one payload or several.
    every = [d for t in texts for d, _ in media.chunks(media.payload(t)[0])]
    often = {d for d in every if every.count(d) > 1}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + b"\xff" * ((-len(raw) % 576) or (0 if raw else 576))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        parts = media.chunks(data)
        stored = media.store(parts, [d in often for d, _ in parts])
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[6]["feature"] == got[7]["feature"] and got[6]["media_bytes"] < 2000 < got[6]["payload_bytes"]
    assert media.media_features(frame(spark, texts).limit(0)).count() == 0


def test_stored_media(spark):
    """What is stored shrinks with repeated payloads, and a lost or damaged chunk is an error."""
    rng = random.Random(4)
    text = " ".join(words(rng, 9000))
    once, often = (media.store_payloads(frame(spark, [text + f" {i}" for i in range(n)])) for n in (1, 40))
    size = lambda s: s[0].agg(F.sum(F.octet_length("container"))).first()[0] + (s[1].agg(F.sum(F.octet_length("chunk"))).first()[0] or 0)
    assert size(often) < 40 * size(once) / 5 and often[1].count() > 5
    assert media.read_payloads(*often).count() == 40
    lost = often[1].orderBy("digest").first()["digest"]
    with pytest.raises(Exception, match="is not in the store"):
        media.read_payloads(often[0], often[1].filter(F.col("digest") != F.lit(lost))).collect()
    with pytest.raises(Exception, match="does not match its digest"):
        media.read_payloads(often[0], often[1].withColumn("chunk", F.when(F.col("digest") == F.lit(lost), F.expr("concat(X'00', substring(chunk, 2))")).otherwise(F.col("chunk")))).collect()


def test_media_repeated_rows_and_null_ids(spark):
    got = media.media_features(frame(spark, ["same", "same", "same"], [None, 1, 1])).collect()
    assert len(got) == 3 and len({r["media_sha256"] for r in got}) == 1


# ---- simhash ----------------------------------------------------------------


def brute_print(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_texts(seed=4):
    rng = random.Random(seed)
    texts = list(ODD) + ["\n".join(words(rng, 3)) for _ in range(3)]
    for _ in range(25):
        base = words(rng, 250, 5000)
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    return texts


def test_fingerprints_equal_brute_force():
    texts = near_texts()
    assert simhash.fingerprints_of(texts).tolist() == [brute_print(t) for t in texts]
    assert simhash.fingerprints_of([]).tolist() == []


@pytest.mark.parametrize("leaf,homes", [(4096, 16384), (8, 5)])
def test_components_equal_brute_force(spark, monkeypatch, leaf, homes):
    monkeypatch.setattr(simhash.links, "__defaults__", (leaf, homes))
    texts = near_texts()
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(1).shuffle(ids)
    prints = [brute_print(t) for t in texts]
    pairs = [(ids[i], ids[j]) for i, j in itertools.combinations(range(len(ids)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = brute_components(pairs, ids)
    got = simhash.near_duplicates(frame(spark, texts, ids)).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{p:016x}", want[d]) for d, p in zip(ids, prints)}


def test_links_of_close_fingerprints(spark, monkeypatch):
    """A dense ball: every distance around the radius, no pair lost, no pair too many."""
    monkeypatch.setattr(simhash.links, "__defaults__", (8, 5))
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = set()
    for c in centres:
        for _ in range(15):
            x = c
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = brute_components([(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3], signed)
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert {v: got.get(v, v) for v in signed} == want


def test_near_duplicates_of_nothing_and_nulls(spark):
    docs = frame(spark, ["a b c d", "a b c d", None], [None, 5, None])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "None"]


def test_representatives_are_rows_not_ids(spark):
    """Repeated and null ids, equal rows and clashing column names: one row of each component, none lost."""
    rng = random.Random(14)
    a, b, c = (" ".join(words(rng, 60, 5000)) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (None, b), (None, c), (None, c), (4, a)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, __key1 string, __kept string")
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([(1, a), (1, b), (None, c)], "doc_id long, text string").collect()))


def test_removal_is_by_row(spark):
    """A repeat leaves the rows that hold it, null ids included; other rows of the id stay whole."""
    rng = random.Random(15)
    p, own = " ".join(words(rng, 60, 5000)), " ".join(words(rng, 80, 5000))
    docs = spark.createDataFrame([(2, p, "x"), (3, "head " + p, "x"), (3, own, "x"), (None, "tail\n" + p, "x"), (4, None, "x")], "doc_id long, text string, __spans string")
    exact = queries.passages.repeated_passages(docs)
    # As a whole line, the paragraph after "head" is a near copy; as a passage, only the copy goes.
    for found, left in ((exact, "head"), (paragraphs.repeated_paragraphs(docs).select(exact.columns).unionByName(exact), "")):
        got = {(r["doc_id"], r["text"]) for r in paragraphs.remove_repeats(docs, found).collect()}
        assert {(d, (t or "").strip()) for d, t in got} == {(2, p), (3, left), (3, own), (None, "tail"), (4, "")}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (None, 3), (61, 60), (60, 61)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(60)}, 60: 60, 61: 60}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- paragraphs -------------------------------------------------------------


def shingle_set(tokens):
    """Five-word shingles as strings."""
    return frozenset(" ".join(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4)))


def brute_repeats(texts, min_words):
    """Whole lines only: none of the texts here has a longer one."""
    lines = [(d, [x.lower().split() for x in (t or "").split("\n")]) for d, t in enumerate(texts)]
    rows = [(d, n, shingle_set(w)) for d, ls in lines for n, w in enumerate([w for w in ls if len(w) >= min_words])]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(rows[i][2] & rows[j][2]) >= 0.8 * len(rows[i][2] | rows[j][2])]
    comp = brute_components(pairs, range(len(rows)))
    groups = {}
    for i, c in comp.items():
        groups.setdefault(c, []).append(i)
    return {frozenset((rows[i][0], rows[i][1]) for i in g) for g in groups.values() if len({rows[i][0] for i in g}) > 1}


@pytest.mark.parametrize("block,probes", [(16_384, 65_536), (4, 7)])
def test_repeats_equal_brute_force(spark, monkeypatch, block, probes):
    monkeypatch.setattr(paragraphs, "BLOCK", block)
    monkeypatch.setattr(paragraphs, "PROBES", probes)
    rng = random.Random(6)
    passages = [words(rng, 60, 3000) for _ in range(12)]
    texts = list(ODD)
    for d in range(60):
        lines = [" ".join(words(rng, rng.randrange(20, 90), 3000)) for _ in range(2)]
        for _ in range(2):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(5, 55)] = "edit"
            lines.append(" ".join(p))
        texts.append("\n".join(lines) + "\nAll rights reserved.")
    texts.append("\n".join([" ".join(passages[0][:51] + ["own"] * 40)] * 2))
    got = paragraphs.repeated_paragraphs(frame(spark, texts)).collect()
    classes = {}
    for r in got:
        classes.setdefault(r["class_id"], []).append(r)
        assert texts[r["doc_id"]][r["span_start"] : r["span_end"]].split() and r["n_words"] >= 50
    assert {frozenset((r["doc_id"], r["para_no"]) for r in c) for c in classes.values()} == brute_repeats(texts, 50)
    assert all(sum(r["keep"] for r in c) == 1 and min((r["doc_id"], r["para_no"]) for r in c) == next((r["doc_id"], r["para_no"]) for r in c if r["keep"]) for c in classes.values())
    clean = paragraphs.remove_repeats(frame(spark, texts), paragraphs.repeated_paragraphs(frame(spark, texts)))
    assert paragraphs.repeated_paragraphs(clean).count() == 0 and clean.columns == frame(spark, texts).columns


def test_local_links_of_variants():
    """Variants of one base: exact links without all pairs, homes in blocks included."""
    rng = random.Random(3)
    base = words(rng, 70, 5000)
    sets = []
    for i in range(120):
        w = list(base)
        for k in range(rng.randrange(5)):
            w[rng.randrange(70)] = f"e{i}_{k}"
        sets.append(w)
    texts = paragraphs.Stream([" ".join(w) for w in sets])
    sets = paragraphs.shingle_lists(texts, *paragraphs.cut(texts))
    assert [len(s) for s in sets] == [66] * 120
    keys = np.arange(500, 620)
    pairs = [(500 + i, 500 + j) for i, j in itertools.combinations(range(120), 2) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))]
    want = brute_components(pairs, keys.tolist())
    whole = paragraphs.local_links(keys, sets, np.ones(120, bool))
    halves = paragraphs.local_links(keys, sets, keys % 2 == 0) + paragraphs.local_links(keys, sets, keys % 2 == 1)
    assert len(whole) < 120 and brute_components(whole, keys.tolist()) == want == brute_components(halves, keys.tolist())


def test_repeats_of_nothing(spark):
    assert paragraphs.repeated_paragraphs(frame(spark, ODD)).count() == 0
    assert paragraphs.repeated_paragraphs(frame(spark, ODD).limit(0)).count() == 0


def test_tuned_bands_and_long_lines():
    bands, rows = paragraphs.tune()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    rng = random.Random(8)
    shared = words(rng, 400, 5000)
    a, b = (" ".join(words(rng, n, 5000) + shared) for n in (33, 71))

    def cut(text):
        words = paragraphs.Stream([text])
        first, last = paragraphs.cut(words)
        assert (last - first >= 50).all() and (last - first <= paragraphs.LONG_WORDS).all()
        return {" ".join(text.split()[i:j]) for i, j in zip(first, last)}

    assert cut(a) & cut(b)


# ---- chat -------------------------------------------------------------------


def test_escaping_is_reversible():
    for t in ["<|im_end|>", "<\\|x", "<\\\\|", "<|<|", "a<b|c", "<||", "\\<|"]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_parts_round_trip():
    parts = [{"type": "text", "text": "see <|image_0|> "}, {"type": "image", "ref": "a.png", "units": 2}, {"type": "audio", "ref": "b.wav", "units": 1}, {"type": "image", "ref": "c.png", "units": 1}, {"type": "document", "ref": "d.pdf", "units": 3}, {"type": "text", "text": "end"}]
    content, attached = chat.flatten(parts)
    assert [a[:3] for a in attached] == [("image", 0, "a.png"), ("audio", 0, "b.wav"), ("image", 1, "c.png"), ("document", 0, "d.pdf")] and attached[0][3] == 512
    assert chat.restore(content, attached) == parts
    with pytest.raises(ValueError):
        chat.flatten([{"type": "video"}])


def test_conversations_equal_brute_force(spark):
    rows = [(1, 1, "assistant", "b\nc <|im_end|>\n"), (1, 0, "user", None), (2, 0, "sys\ntem\\n", ""), (2, 0, "sys\ntem\\n", ""), (3, 0, "assistant", "🙂é"), (None, 1, "user", "x"), (3, 1, None, "<\\|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        all_turns = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


def test_attachments_in_frames(spark):
    df = spark.createDataFrame([(1, 0, "user", "t", [("image", None, "a.png", 2), ("text", "hi", None, None)])], f"conv_id long, turn long, role string, text string, parts array<struct<{chat.PART.replace(' ', ':').replace(',:', ', ')}>>")
    r = chat.format_turns(df, parts="parts").first()
    assert r["formatted"] == "<|im_start|>user\n<|image_0|>hi<|im_end|>\n" and r["tokens"] == 512 and r["refs"] == ["a.png"]


def test_parts_and_loss_spans_read_back_from_frames(spark):
    """Every part comes back from the formatted turn and its attachments; the loss span is the content."""
    rows = [
        (1, 0, "user", [("text", "see <|image_0|> \\", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", 1), ("image", None, "c.png", 1)]),
        (1, 1, "assistant", [("text", "done <|im_end|>", None, None), ("document", None, "d.pdf", 3)]),
        (None, 0, "ro\nle", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<struct<{chat.PART.replace(' ', ':').replace(',:', ', ')}>>").withColumn("text", F.lit(None).cast("string")).withColumn("attachments", F.lit("clash"))
    turns = chat.format_turns(df, parts="parts")
    back = {(r["conv_id"], r["turn"]): (r["role"], [tuple(p) for p in r["parts"]]) for r in chat.restore_parts(turns).collect()}
    assert back == {(c, t): (role, parts) for c, t, role, parts in rows}
    spans = {r["role"]: r["formatted"][r["loss_start"] : r["loss_end"]] if r["loss_start"] is not None else None for r in turns.collect()}
    assert spans == {"user": None, "assistant": chat.escape("done <|im_end|>") + "<|document_0|>", "ro\nle": None}


# ---- WARC -------------------------------------------------------------------


def test_audit_finds_exactly_the_damage(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(300)] + [(None, None, None), (5, "http://x/5", "<p>5</p>" * 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    found = warc.audit(pages, queries.damaged(pages), file_records=64).collect()
    assert {r["page_id"] for r in found if r["corrupt"]} == {i for i in range(300) if i % 97 == 0 and i % 5}
    assert sum(r["copies"] for r in found) == len(rows) and [r["copies"] for r in found if r["page_id"] == 5] == [2]
    by_file = {}
    for r in found:
        by_file.setdefault(r["warc_file"], []).append((r["record_no"], r["record_offset"], r["record_bytes"]))
    for records in by_file.values():
        at = 0
        for n, (no, offset, size) in enumerate(sorted(records)):
            assert no == n and offset == at
            at += size
    assert not [r for r in warc.audit(pages, pages).collect() if r["corrupt"]]


def test_audit_of_lost_and_empty_replicas(spark):
    pages = spark.createDataFrame([(i, "u", "h") for i in range(50)], "page_id long, url string, html string")
    lost = warc.audit(pages, pages.filter("page_id <> 20"), file_records=64).collect()
    assert {r["page_id"] for r in lost if r["corrupt"]} == {20}
    assert all(r["corrupt"] for r in warc.audit(pages, pages.limit(0)).collect()) and warc.audit(pages.limit(0), pages).count() == 0


def test_damage_at_rest(spark):
    """Bytes overwritten in a stored replica: the record is found by its place, and only it."""
    pages = spark.createDataFrame([(i, "ü", "h" * (i % 7)) for i in range(400)] + [(None, "u", "é")] * 3, "page_id long, url string, html string")
    shape = warc.geometry(pages, 64)
    primary = warc.write_replica(pages, shape)
    assert all(bytes(r["raw"])[r["body_at"] : -4].decode() == {i: "h" * (i % 7) for i in range(400)}.get(r["page_id"], "é") for r in primary.collect())
    got = warc.compare(primary, queries.damaged_at_rest(primary), shape).collect()
    assert {(r["page_id"], r["copies"], r["replica_copies"]) for r in got if r["corrupt"]} == {(i, 1, 1) for i in range(0, 400, 97) if i % 7}
    assert len(got) == 401 and not [r for r in warc.compare(primary, primary, shape).collect() if r["corrupt"]]
    # The audit descends into the branches that differ only.
    trees = [warc.tree(warc.records(x), shape[0]) for x in (primary, queries.damaged_at_rest(primary))]
    bad = {r["node"] for r in warc.descend(*trees).collect()}
    assert bad == {r["node"] for r in primary.filter("page_id % 97 = 0 and page_id % 7 > 0").collect()}


# ---- pipeline ---------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    texts = [" ".join(words(rng, 80, 900)) for _ in range(60)]
    item = " ".join(f"bench{i}" for i in range(14))
    for i in range(0, 60, 6):
        texts[i] += " moron idiot moron"
    texts[1] = texts[2]
    texts[3] += " " + item
    texts[4] += " password=abcdefgh1234"
    docs = frame(spark, [*texts, None, ""])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / f"s{n}"))
        df = spark.read.parquet(str(tmp_path / f"s{n}"))
        assert df.columns == docs.columns
        kept[name] = {r["doc_id"] for r in df.select("doc_id").collect()}
    assert kept["toxicity"] == set(range(62)) - set(range(0, 60, 6))
    assert kept["simhash"] == kept["toxicity"] - {2, 61}
    assert kept["decontamination"] == kept["simhash"] - {3} and kept["secrets"] == kept["decontamination"]
    assert "abcdefgh1234" not in df.filter("doc_id = 4").first()["text"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == kept["secrets"]
