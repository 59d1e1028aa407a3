"""Repeated passages by MinHash bands of sliding paragraphs: runs of ``min_words`` words or more in two documents.

The words of a whole text form one stream, so line breaks and the text around a
passage play no part.  Every window of ``min_words`` words is a paragraph of its
own.  It has one MinHash band: the least values of its five-word shingles under
``ROWS`` hash functions.  Equal windows have equal shingles, so at similarity 1
one band has a recall of 1, and only windows whose band two documents hold are
looked at.  Neighbouring windows of one band are a group.  Where all groups of a
bucket are equal they are counted whole; where they differ, each window of the
bucket is verified by a hash of its words.  Counting is by hash, nothing is
paired.  Neighbouring repeated windows make a passage.

A passage is kept where its windows occur for the first time, in the document
of the smallest id; ``class_id`` names the kept passage that a copy's first
window lies in.  Passages of one text may overlap where their first occurrences
differ.

Defined cases: null and short texts have no passages; what repeats within one
document only is no passage; null ids are one document, which comes last; equal
rows of an id are one row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, arrow_map, slices, written

MIN_WORDS = 50
SHINGLE, ROWS = 5, 2
SLICE = 1 << 20
BUFFER = 100_000
BLOOM_BITS = 1 << 28
NULL_NAME = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LAST = 0x3001
_SPACE = np.array([chr(c).isspace() for c in range(_LAST)] + [False])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lower(text: str) -> str:
    """Lower case, of the same length."""
    low = text.lower()
    if len(low) == len(text):
        return low
    same = lambda w: w.lower() if len(w.lower()) == len(w) else "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
    return "".join(map(same, re.split(r"(\s+)", text)))


class Stream:
    """The lower-cased words of some texts as one stream: hash, text, line, and place in code points of each."""

    def __init__(self, texts: list[str | None]):
        sizes = np.array([len(t or "") for t in texts], np.int64)
        offsets = np.cumsum(sizes + 1) - sizes - 1
        whole = "\n".join(_lower(t or "") for t in texts)
        # One byte a character is enough for most texts.
        chars = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = _SPACE[chars if chars.itemsize == 1 else np.minimum(chars, _LAST)]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
        starts, ends = edges[::2], edges[1::2]
        # A word's hash is a polynomial of its characters, taken from prefix sums.
        powers, back = _powers(len(chars))
        prefix = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(chars * powers, out=prefix[1:])
        self.hashes = _mix((prefix[ends] - prefix[starts]) * back[starts])
        self.text = np.searchsorted(offsets, starts, "right") - 1
        self.line = np.searchsorted(np.flatnonzero(chars == 10), starts)
        self.starts, self.ends = starts - offsets[self.text], ends - offsets[self.text]
        n = len(self.hashes)
        powers, self.back = _powers(n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * powers[:n])))

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``first`` up to, without, ``last``; equal words have equal ones wherever they are."""
        return _mix((self.sums[last] - self.sums[first]) * self.back[first])

    def grams(self, k: int) -> np.ndarray:
        """Hash of each ``k`` neighbouring words."""
        n = len(self.hashes) - k + 1
        return _mix((self.sums[k:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


@lru_cache(1)
def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full((2, n), _BASE, np.uint64)
    out[1] = _INVERSE
    out[:, 0] = 1
    return tuple(np.cumprod(out, axis=1))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; those of a usual slice are kept."""
    usual = 2 * SLICE
    powers, back = _table(usual) if n <= usual else _table.__wrapped__(n)
    return powers[:n], back[:n]


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a, done = np.minimum(a[:-step], a[step:]), done + step
    return a


def windows_of(texts: list[str | None], min_words: int = MIN_WORDS, grouped: bool = False) -> tuple[np.ndarray, ...]:
    """``(hash, band, text number, position, windows, start, end)`` of every window or group."""
    words = Stream(texts)
    text, n = words.text, len(words.hashes) - min_words + 1
    if n < 1:
        return (*(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 5)
    size = min(SHINGLE, min_words)
    inside = text[:n] == text[min_words - 1 :]
    first = np.searchsorted(text, text[:n])
    shingles, bands = words.grams(size), np.zeros(n, np.uint64)
    for row in range(ROWS):
        bands = _mix(bands ^ _least(_mix(shingles + np.uint64(row)), min_words - size + 1))
    at = np.flatnonzero(inside)
    last = at
    if grouped and len(at):
        new = np.append(True, (bands[at][1:] != bands[at][:-1]) | (text[at][1:] != text[at][:-1]))
        at, last = at[new], at[np.append(new[1:], True)]
    hashes = words.between(at, last + min_words) ^ (last - at).astype(np.uint64)
    return hashes, bands[at], text[at], at - first[at], last - at + 1, words.starts[at], words.ends[last + min_words - 1]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def buckets(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(band)``: the bands of windows that two documents hold."""

    def run(batches):
        for b in batches:
            names, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for i, j in slices(texts, SLICE):
                _, bands, text, *_ = windows_of(texts[i:j], min_words)
                if len(bands):
                    new = np.append(True, (bands[1:] != bands[:-1]) | (text[1:] != text[:-1]))
                    yield pa.RecordBatch.from_arrays([_long(bands[new]), _long(names[i:j][text[new]])], ["band", "name"])

    rows = arrow_map(docs, run, "band long, name long").groupBy("band").agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
    return rows.filter("lo < hi").select("band")


def candidates(docs: DataFrame, wanted: DataFrame, min_words: int = MIN_WORDS, grouped: bool = False) -> DataFrame:
    """The windows or groups whose band may be in ``wanted``; part tells texts of one id apart."""
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(wanted, "band", BLOOM_BITS))

    def run(batches):
        known = bloom.value
        for b in batches:
            names, texts, parts = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
            for i, j in slices(texts, SLICE):
                found = windows_of(texts[i:j], min_words, grouped)
                may = known.has(found[1].view(np.int64))
                if may.any():
                    hashes, bands, text, pos, n, start, end = (x[may] for x in found)
                    yield pa.RecordBatch.from_arrays([_long(hashes), _long(bands if grouped else np.zeros_like(bands)), _long(names[i:j][text]), _long(parts[i:j][text]), *map(_int, (pos, n, start, end))], ["hash", "band", "name", "part", "pos", "n", "start", "end"])

    return arrow_map(docs, run, "hash long, band long, name long, part long, pos int, n int, start int, end int")


def runs_of(name: np.ndarray, part: np.ndarray, pos: np.ndarray, n: np.ndarray, hashes: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, keep) rows of the passages among repeated windows in text order."""
    same = (name[1:] == name[:-1]) & (part[1:] == part[:-1])
    text = np.cumsum(np.append(0, ~same))
    order = np.lexsort((np.arange(len(pos)), hashes, text))
    again = np.zeros(len(pos), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    keep = (name == lo) & ~again
    on = same & (pos[1:] == pos[:-1] + n[:-1]) & (keep[1:] == keep[:-1]) & (lo[1:] == lo[:-1])
    return np.flatnonzero(np.append(True, ~on)), np.flatnonzero(np.append(~on, True)), keep


def passages(windows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of neighbouring windows and groups; a kept one has the hashes of its members."""

    def made(held):
        name, part, pos, n, start, end, hashes, lo = (np.concatenate(x) for x in zip(*held))
        # Equal rows, and windows that a Bloom filter let through though their group is counted whole, go.
        text = np.cumsum(np.append(0, (name[1:] != name[:-1]) | (part[1:] != part[:-1]))) << 32
        one = np.append(True, np.maximum.accumulate(text + pos + n)[:-1] <= (text + pos)[1:])
        name, part, pos, n, start, end, hashes, lo = (x[one] for x in (name, part, pos, n, start, end, hashes, lo))
        first, last, keep = runs_of(name, part, pos, n, hashes, lo)
        kept = [hashes[a : b + 1] if keep[a] else hashes[:0] for a, b in zip(first, last)]
        return pa.RecordBatch.from_arrays(
            [_long(name[first]), _long(part[first]), _long(start[first]), _long(end[last]), _long(pos[last] + n[last] - 1 - pos[first] + min_words), _long(hashes[first]), pa.array(keep[first]), pa.array(kept, pa.list_(pa.int64()))],
            ["name", "part", "span_start", "span_end", "n_words", "hash", "keep", "hashes"],
        )

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(i).to_numpy() for i in range(8)])
            rows += b.num_rows
            if rows >= BUFFER:
                name, part = held[-1][0], held[-1][1]
                cut = np.flatnonzero((name[1:] != name[:-1]) | (part[1:] != part[:-1]))
                if len(cut):
                    tail = [x[cut[-1] + 1 :] for x in held[-1]]
                    held[-1] = [x[: cut[-1] + 1] for x in held[-1]]
                    yield made(held)
                    held, rows = [tail], len(tail[0])
        if held:
            yield made(held)

    dealt = windows.select("name", "part", "pos", "n", "start", "end", "hash", "lo").repartition("name", "part").sortWithinPartitions("name", "part", "pos", F.desc("n"))
    return arrow_map(dealt, run, "name long, part long, span_start long, span_end long, n_words long, hash long, keep boolean, hashes array<long>")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, text_hash, span_start, span_end, n_words, class_id, keep)`` of each repeated passage."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_NAME)).alias("name"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("part"))
    wanted = written(buckets(texts, min_words), "buckets")
    groups = written(candidates(texts, wanted, min_words, grouped=True), "groups")
    kinds = groups.groupBy("band", "hash").agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
    shared = written(kinds.groupBy("band").agg(F.count("*").alias("kinds"), F.min("hash").alias("hash"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi"), "shared")
    windows = written(candidates(texts, shared.filter("kinds > 1").select("band"), min_words), "windows")
    repeated = windows.groupBy("hash").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).filter("lo < hi").select("hash", "lo")
    whole = groups.join(shared.filter("kinds = 1").select("band", "lo"), "band").drop("band")
    members = whole.unionByName(windows.drop("band").join(repeated, "hash"))
    found = written(passages(members, min_words), "passages")
    kept = found.filter("keep").select(F.explode("hashes").alias("hash"), F.col("hash").alias("class_id")).groupBy("hash").agg(F.min("class_id").alias("class_id"))
    doc_id = F.nullif(F.col("name"), F.lit(NULL_NAME)).alias("doc_id")
    return found.drop("hashes").join(kept, "hash").select(doc_id, F.col("part").alias("text_hash"), "span_start", "span_end", "n_words", "class_id", "keep")
