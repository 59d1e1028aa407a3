"""Repeated passages against brute force over every window of 50 words."""

import random

from foliospark.llm import passages, queries

DOCS = "doc_id long, text string"


def words(rng, n, size=3000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def wrapped(rng, tokens, most):
    out = []
    while tokens:
        n = rng.randrange(1, most)
        out.append(" ".join(tokens[:n]))
        tokens = tokens[n:]
    return "\n".join(out)


def covered(rows, n=50):
    """(row, word) of every window of ``n`` words that two ids hold."""
    seen = {}
    for k, (doc, text) in enumerate(rows):
        w = (text or "").lower().split()
        for p in range(len(w) - n + 1):
            seen.setdefault(tuple(w[p : p + n]), []).append((doc, k, p))
    return {(k, p + i) for at in seen.values() if len({d for d, _, _ in at}) > 1 for _, k, p in at for i in range(n)}


def planted():
    rng = random.Random(21)
    shared = [words(rng, n) for n in (50, 51, 51, 60, 75, 100, 49, 300)]
    rows = [(None, None), (90, ""), (91, "x y z")]
    for d in range(40):
        tokens = words(rng, rng.randrange(0, 120))
        for _ in range(2):
            tokens += rng.choice(shared) + words(rng, rng.randrange(0, 80))
        rows.append((d, wrapped(rng, tokens, 12 if d % 2 else 900)))
    own = " ".join(words(rng, 70))
    rows += [(50, own + "\n" + own), (None, " ".join(shared[7]).upper()), (51, "İ   \U0001f642 " + " ".join(shared[3])), (3, rows[6][1])]
    return rows


def test_passages_equal_brute_force(spark):
    rows = planted()
    got = passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], set()).add((r["span_start"], r["span_end"]))
    want = {}
    for k, p in covered(rows):
        want.setdefault(rows[k][0], set()).add((k, p))
    assert spans.keys() == want.keys()
    for k, (doc, text) in enumerate(rows):
        if [d for d, _ in rows].count(doc) > 1 or text is None:
            continue
        at, hit = 0, set()
        for n, w in enumerate(text.split()):
            at = text.index(w, at)
            if any(a <= at and at + len(w) <= z for a, z in spans.get(doc, ())):
                hit.add((k, n))
            at += len(w)
        assert hit == want.get(doc, set()), doc
    classes = {}
    for r in got:
        classes.setdefault(r["class_id"], []).append(r)
    assert all(any(r["keep"] for r in c) and any(not r["keep"] for r in c) for c in classes.values())


def test_passages_of_nothing(spark):
    df = spark.createDataFrame(planted()[:3], DOCS)
    assert passages.repeated_passages(df).count() == 0 and passages.repeated_passages(df.limit(0)).count() == 0


def test_query_finds_passages_across_and_inside_lines(spark, tmp_path):
    """A passage over short lines and inside a longer line; whole lines alone do not show it."""
    rng = random.Random(5)
    p = words(rng, 56)
    rows = [(1, wrapped(rng, list(p), 9)), (2, " ".join(words(rng, 90) + p + words(rng, 90))), (3, " ".join(words(rng, 200)))]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_substring_dedup(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["n_words"], r["keep"]) for r in got} == {(1, 56, True), (2, 56, False)}
    assert all(rows[r["doc_id"] - 1][1][r["span_start"] : r["span_end"]].split() == p for r in got)
