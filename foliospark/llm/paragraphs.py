"""Substring deduplication: paragraph MinHash bands, exact Jaccard, components.

Paragraphs are lines of at least ``min_words`` words; lines of over ``LONG_WORDS``
are cut at content-defined words.  Passages inside lines or across them are the
matter of ``passages.py``, which bands every window of words.  Equal paragraphs are collapsed by their hash first.  Distinct ones
get MinHash values of their five-word shingles, grouped in bands that are
tuned for a given recall at the threshold.  The members of a bucket are joined
in one place by a prefix filter, exact Jaccard similarity and a union-find, which
yields a spanning edge for each connected member and never all pairs; a very
large bucket is dealt out in blocks.  Connected components of the edges are the
classes.  A class that spans two documents or more is reported; its first
occurrence is the one to keep.

Defined cases: null and empty texts and lines under ``min_words`` have no
paragraphs; a line repeated within one document only is not a class; a null id
is a document of its own kind and comes last when the first occurrence is
chosen; repeated rows count as one document; an empty table gives an empty
result; a very long line is cut into many paragraphs; ties cannot arise, as a place
holds id, text and number; rows of one id with different texts are told apart by a
hash of the text; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, arrow_map, fresh, slices, written
from .components import connected_components
from .passages import Stream

SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 50
LONG_WORDS = 240
MARK_EVERY = 32
"""A line of over LONG_WORDS words may be cut after one word of so many."""
BLOCK, PROBES = 16_384, 65_536
STREAM_CHARS = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def tune(threshold: float = SIMILARITY, recall: float = 0.999, low: float = 0.3, noise: float = 0.5, most_rows: int = 8) -> tuple[int, int]:
    """(bands, rows): the fewest bands that reach ``recall`` at ``threshold``.

    Chance collisions at similarity ``low`` stay below ``noise``.
    """
    found = []
    for rows in range(1, most_rows + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - low**rows) ** bands <= noise:
            found.append((bands * (1 + rows / 8), bands, rows))
    return min(found)[1:]


def cut(words: Stream, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each paragraph and the one after its last, in order."""
    line = words.line
    edges = np.concatenate(([0], np.flatnonzero(line[1:] != line[:-1]) + 1, [len(line)])).astype(np.int64)
    first, last = edges[:-1], edges[1:]
    full = last - first >= min_words
    out = []
    for at, end in zip(first[full].tolist(), last[full].tolist()):
        if end - at > long_words:
            marks = at + 1 + np.flatnonzero(words.hashes[at:end] % np.uint64(MARK_EVERY) == 0)
            while end - at >= min_words:
                k = int(np.searchsorted(marks, at + min_words))
                stop = int(marks[k]) if k < len(marks) and marks[k] <= end - min_words else end
                stop = min(stop, at + long_words)
                out.append((at, stop))
                at = stop
        else:
            out.append((at, end))
    spans = np.array(out, np.int64).reshape(-1, 2)
    return spans[:, 0], spans[:, 1]


def shingle_lists(words: Stream, first: np.ndarray, last: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingle hashes of each paragraph; fewer words than a shingle are one shingle."""
    grams = words.grams(size)
    return [np.unique(grams[a : b - size + 1]) if b - a >= size else words.between(np.array([a]), np.array([b])) for a, b in zip(first.tolist(), last.tolist())]


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (sets x bands) of the MinHash values."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    rng = np.random.Generator(np.random.PCG64(11))
    odd = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            x = flat * odd[b * rows + r]
            x ^= x >> np.uint64(32)
            h = (h ^ np.minimum.reduceat(x, starts)) * _P
            h ^= h >> np.uint64(31)
        out[:, b] = h
    return out


def occurrences(docs: DataFrame, bands: int, rows: int, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each paragraph: place, hash of its words, and band hashes."""

    def run(batches):
        for b in batches:
            ids, hashes = b.column(0), b.column(2)
            texts = b.column(1).to_pylist()
            for i, j in slices(texts, STREAM_CHARS):
                words = Stream(texts[i:j])
                first, last = cut(words, min_words)
                if not len(first):
                    continue
                text = words.text[first]
                number = np.arange(len(text)) - np.searchsorted(text, text)
                sig = signatures(shingle_lists(words, first, last), bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * bands), pa.array(sig.ravel()))
                owner = pa.array(text + i)
                columns = (number, words.starts[first], words.ends[last - 1], last - first, words.between(first, last).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids.take(owner), hashes.take(owner), *map(pa.array, columns), lists], ["doc_id", "text_hash", "para_no", "span_start", "span_end", "n_words", "key", "bands"])

    return arrow_map(docs, run, "doc_id long, text_hash long, para_no long, span_start long, span_end long, n_words long, key long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(key, hashes)`` of the paragraphs whose key is in ``wanted``."""
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(wanted, "key"))

    def run(batches):
        known, sent = bloom.value, set()
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in slices(texts, STREAM_CHARS):
                words = Stream(texts[i:j])
                first, last = cut(words, min_words)
                keys = words.between(first, last).view(np.int64)
                maybe = np.flatnonzero(known.has(keys)) if len(keys) else keys
                new = {int(keys[k]): k for k in maybe if int(keys[k]) not in sent}
                sent.update(new)
                if len(sent) > 500_000:
                    sent.clear()
                at = np.fromiter(new.values(), np.int64, len(new))
                sets = [x.view(np.int64) for x in shingle_lists(words, first[at], last[at])]
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "hashes"])

    rows = arrow_map(docs.select("text"), run, "key long, hashes array<long>")
    return rows.join(wanted, "key", "left_semi").dropDuplicates(["key"])


def local_links(keys: np.ndarray, sets: list[np.ndarray], home: np.ndarray, threshold: float = SIMILARITY) -> list[tuple[int, int]]:
    """Spanning edges of the exact similarity graph between homes and all members.

    Prefix filter: with the rarest shingles first, two sets of the given
    similarity share one of the first ``n - ceil(threshold * n) + 1`` of each.
    Only members that do so and are not connected yet are compared in full, so
    variants that differ from all others cost next to nothing.
    """
    n = len(keys)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(keys[0]), int(keys[1]))] if both >= threshold * (len(sets[0]) + len(sets[1]) - both) else []
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.lexsort((token, count[token], owner))
    token = token[order]  # each set's tokens, rarest first
    prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
    inside = np.arange(len(token)) - starts[owner] < prefix[owner]
    kept = inside & home[owner]
    by_token = np.argsort(token[kept], kind="stable")
    listed, holder = token[kept][by_token], owner[kept][by_token]
    lo = np.searchsorted(listed, np.arange(len(count)))
    hi = np.searchsorted(listed, np.arange(len(count)), "right")
    parent = np.arange(n)
    mark = np.zeros(len(count), np.int64)

    def roots(i: np.ndarray) -> np.ndarray:
        r = parent[i]
        while True:
            up = parent[r]
            if (up == r).all():
                parent[i] = r
                return r
            r = up

    for i in range(n):
        own = token[starts[i] : ends[i]]
        near = [holder[lo[t] : hi[t]] for t in own[: prefix[i]] if hi[t] > lo[t]]
        if not near:
            continue
        c = np.unique(np.concatenate(near))
        c = c[(c != i) & (sizes[c] >= threshold * sizes[i]) & (sizes[i] >= threshold * sizes[c])]
        c = c[roots(c) != roots(np.array([i]))[0]]
        if not len(c):
            continue
        mark[own] = 1
        at = np.cumsum(sizes[c]) - sizes[c]
        flat = np.repeat(starts[c] - at, sizes[c]) + np.arange(sizes[c].sum())
        both = np.add.reduceat(mark[token[flat]], at)
        mark[own] = 0
        c = c[both >= threshold * (sizes[i] + sizes[c] - both)]
        if len(c):
            r = np.unique(roots(np.append(c, i)))
            parent[r] = r[0]
    root = roots(np.arange(n))
    return [(int(keys[i]), int(keys[root[i]])) for i in np.flatnonzero(root != np.arange(n))]


def similar_pairs(distinct: DataFrame, docs: DataFrame, threshold: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """Edges ``(src, dst)`` that connect what exact Jaccard connects within a bucket.

    A bucket is searched in one place; one of over ``BLOCK`` members is dealt
    out in blocks of homes, each of which meets all members in parts.
    """
    rows = distinct.select("key", F.explode("bands").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(rows.join(crowded, "bucket"), "buckets")
    sets = shingle_sets(docs, members.select("key").distinct(), min_words)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    parts = F.ceil(F.col("n") / PROBES).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("turn", F.pmod(F.xxhash64("key", F.lit(1)), parts).cast("int"))
    # A member goes to every block in its own part, and to every part in its own block.
    where = F.when(F.col("n") <= BLOCK, F.array(F.struct(F.lit(0).alias("block"), F.lit(0).alias("part")))).otherwise(
        F.array_union(
            F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(b.alias("block"), F.col("turn").alias("part"))),
            F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(F.col("own").alias("block"), p.alias("part"))),
        )
    )
    placed = dealt.select("bucket", "key", "own", F.explode(where).alias("w")).select("bucket", F.col("w.block").alias("block"), F.col("w.part").alias("part"), "key", (F.col("own") == F.col("w.block")).alias("home"))
    shards = placed.join(sets, "key").repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part", "key")

    def run(batches):
        now, group = None, []

        def search():
            if len(group) < 2:
                return []
            return local_links(np.array([g[0] for g in group], np.int64), [g[2] for g in group], np.array([g[1] for g in group], bool), threshold)

        def edges(found):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["src", "dst"])

        for b in batches:
            found = []
            values, offsets = b.column(5).values.to_numpy(), b.column(5).offsets.to_numpy()
            for k, shard in enumerate(zip(*(b.column(i).to_pylist() for i in range(5)))):
                if shard[:3] != now:
                    found += search()
                    now, group = shard[:3], []
                group.append((shard[3], shard[4], values[offsets[k] : offsets[k + 1]].copy()))
            yield edges(found)
        yield edges(search())

    return arrow_map(shards.select("bucket", "block", "part", "key", "home", "hashes"), run, "src long, dst long").distinct()


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, recall: float = 0.999, min_words: int = MIN_WORDS) -> DataFrame:
    """Each paragraph of a class that spans documents: its place, class and whether to keep it."""
    bands, rows = tune(threshold, recall)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    found = written(occurrences(texts, bands, rows, min_words), "paragraphs")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("para_no").alias("p"))
    name = F.coalesce("doc_id", F.lit(-(1 << 62)))
    distinct = written(found.groupBy("key").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.min(name).alias("lo"), F.max(name).alias("hi"), F.first("bands").alias("bands")), "distinct")
    member = connected_components(similar_pairs(distinct, texts.select("doc_id", "text"), threshold, min_words)).withColumnRenamed("node", "key")
    classed = distinct.drop("bands").join(member, "key", "left").withColumn("component", F.coalesce("component", "key"))
    spanning = classed.groupBy("component").agg(F.min("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").drop("lo", "hi")
    keys = classed.select("key", "component").join(spanning, "component").withColumnRenamed("first", "kept")
    out = found.drop("bands").join(keys, "key")
    keep = (F.col("kept.d").eqNullSafe(F.col("doc_id"))) & (F.col("kept.t") == F.col("text_hash")) & (F.col("kept.p") == F.col("para_no"))
    return out.select("doc_id", "text_hash", "para_no", "span_start", "span_end", "n_words", F.col("component").alias("class_id"), keep.alias("keep"))


def remove_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans that are not kept cut out of their texts.

    A span belongs to the rows of its id, null included, and of its text; other
    rows of the id stay whole.  Spans may overlap.
    """
    spans, the_id, the_hash = (fresh(docs, x) for x in ("spans", "id", "hash"))
    cut = repeats.filter("not keep").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias(spans))
    cut = cut.withColumnsRenamed({"doc_id": the_id, "text_hash": the_hash})
    text = F.col(text_col)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        part = F.substring(text, acc["at"].cast("int") + 1, F.greatest(F.lit(0), (s["span_start"] - acc["at"]).cast("int")))
        return F.struct(F.greatest(acc["at"], s["span_end"]).alias("at"), F.concat(acc["out"], part).alias("out"))

    clean = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    joined = docs.join(cut, docs[id_col].cast("long").eqNullSafe(F.col(the_id)) & (F.xxhash64(docs[text_col]) == F.col(the_hash)), "left")
    return joined.select(*[F.when(F.col(spans).isNull(), text).otherwise(clean).alias(c) if c == text_col else docs[c] for c in docs.columns])
