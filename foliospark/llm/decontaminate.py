"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` turns each slice of the corpus into one index segment: its
sorted terms, the offsets of their posting lists and the postings, which are
ascending token positions in the segment.  Segments are rows of a written
table, each with an id of its own, so building needs no shuffle and the index
follows the documents.

``search_windows`` sends the test items to the segments in blocks of bounded
size.  For a window it starts from the posting list of the rarest term in the
segment and intersects it with the offset-adjusted lists of the other terms,
rarest first; what is left are the exact occurrences.  ``search_proximity``
reports documents that hold all terms of a query within a span.

Defined cases: a null or wordless text has no words and no hits; a null or
wordless item has no windows; a null item id counts as the item of that text
but has no name in the list; equal item ids are named once; repeated documents
give repeated rows; an empty corpus gives an empty result and an empty item
table no hits; a very long text is one segment of its own; ids do not tell rows
apart, so rows of one id with different texts have results of their own; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, written

WINDOW = 10
ITEM_BLOCK_BYTES = 8 << 20
"""Bytes of item texts that are sent to the executors at once."""

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
SEGMENT = "segment string, doc_ids array<bigint>, row_words array<int>, terms binary, post_at array<int>, posts binary"
COLUMNS = ["doc_ids", "row_words", "terms", "post_at", "posts"]
# Lower-cases A-Z; whatever is no word byte becomes a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(_WORDS).split() if text else []


def _segments(batches):
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, j in slices(texts):
            numbers: dict[bytes, int] = {}
            number = numbers.setdefault
            stream, lengths = [], []
            for t in texts[i:j]:
                words = words_of(t)
                stream.append(np.fromiter((number(w, len(numbers)) for w in words), np.int32, len(words)))
                lengths.append(len(words))
            tokens = np.concatenate(stream) if stream else np.zeros(0, np.int32)
            terms = sorted(numbers)
            rank = np.empty(len(terms), np.int32)
            rank[np.fromiter((numbers[w] for w in terms), np.int32, len(terms))] = np.arange(len(terms), dtype=np.int32)
            ranked = rank[tokens]
            posts = np.argsort(ranked, kind="stable").astype("<i4")
            post_at = np.concatenate([[0], np.cumsum(np.bincount(ranked, minlength=len(terms)))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex], pa.string()),
                    pa.array([ids[i:j]], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([b" ".join(terms)], pa.binary()),
                    pa.array([post_at.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([posts.tobytes()], pa.binary()),
                ],
                ["segment", *COLUMNS],
            )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index segments of ``docs``, all terms and positions of all texts."""
    return written(arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col)), _segments, SEGMENT), "index")


class Segment:
    """One row of the index, opened for queries."""

    @classmethod
    def at(cls, b: pa.RecordBatch, r: int) -> Segment:
        """Row ``r`` of a batch of the index."""
        doc_ids, row_words, terms, post_at, posts = (b.column(b.schema.get_field_index(c))[r] for c in COLUMNS)
        return cls(doc_ids.as_py(), row_words.as_py(), terms.as_py(), post_at.values.to_numpy(), posts.as_py())

    def __init__(self, doc_ids, row_words, terms: bytes, post_at: np.ndarray, posts: bytes):
        self.doc_ids = doc_ids
        self.ends = np.cumsum(np.asarray(row_words, np.int64))
        self.terms = {w: k for k, w in enumerate(terms.split(b" "))} if terms else {}
        self.post_at, self.posts = post_at, np.frombuffer(posts, "<i4")

    def postings(self, term: bytes) -> np.ndarray:
        k = self.terms.get(term)
        return self.posts[self.post_at[k] : self.post_at[k + 1]] if k is not None else self.posts[:0]

    def phrase(self, lists: list[np.ndarray]) -> np.ndarray:
        """Start positions of the phrase whose k-th term has the postings ``lists[k]``."""
        order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
        at = lists[order[0]] - order[0]
        for k in order[1:]:
            if not len(at):
                break
            other = lists[k]
            i = np.searchsorted(other, at + k)
            i[i == len(other)] = 0
            at = at[other[i] == at + k]
        # A phrase does not run from one document into the next.
        if len(at):
            doc = np.searchsorted(self.ends, at, "right")
            at = at[at + len(lists) <= self.ends[doc]]
        return at


def windows_of(words: list[bytes], width: int) -> list[list[bytes]]:
    return [words[i : i + width] for i in range(len(words) - width + 1)] if len(words) >= width else [words] if words else []


def _hits(segment: Segment, items: list[tuple], width: int):
    """Hit marks of the segment's words, and the item names found in each document row."""
    total = int(segment.ends[-1]) if len(segment.ends) else 0
    marks = np.zeros(total + 1, np.int32)
    found: dict[int, set] = {}
    for name, words in items:
        lists = {w: segment.postings(w) for w in set(words)}
        empty = [not len(lists[w]) for w in words]
        span = min(width, len(words))
        gaps = sum(empty[:span])
        for i in range(len(words) - span + 1):
            if i:
                gaps += empty[i + span - 1] - empty[i - 1]
            if gaps:
                continue
            at = segment.phrase([lists[w] for w in words[i : i + span]])
            if len(at):
                np.add.at(marks, at, 1)
                np.add.at(marks, at + span, -1)
                for d in np.unique(np.searchsorted(segment.ends, at, "right")).tolist():
                    found.setdefault(d, set()).add(name)
    return np.cumsum(marks[:-1]) > 0, found


RESULT = "doc_id long, n_words long, n_hit long, items array<string>, marks binary, segment string, row int"


def _search(items_value, width, keep_marks=False):
    def run(batches):
        items = items_value()
        for b in batches:
            for r in range(b.num_rows):
                s = Segment.at(b, r)
                hit, found = _hits(s, items, width)
                total = np.concatenate([[0], np.cumsum(hit)])
                key = b.column(b.schema.get_field_index("segment"))[r].as_py()
                starts = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.doc_ids, pa.int64()),
                        pa.array(s.ends - starts, pa.int64()),
                        pa.array(total[s.ends] - total[starts], pa.int64()),
                        pa.array([sorted(x for x in found.get(d, ()) if x is not None) for d in range(len(starts))], pa.list_(pa.string())),
                        pa.array([np.packbits(hit[x:y]).tobytes() if keep_marks else None for x, y in zip(starts, s.ends)], pa.binary()),
                        pa.array([key] * len(starts), pa.string()),
                        pa.array(range(len(starts)), pa.int32()),
                    ],
                    ["doc_id", "n_words", "n_hit", "items", "marks", "segment", "row"],
                )

    return run


def item_blocks(items: DataFrame, id_col: str, text_col: str, limit: int = ITEM_BLOCK_BYTES):
    """The items as lists of (name, words), each list of about ``limit`` bytes."""
    block, size = [], 0
    for r in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t is not null").orderBy("i", "t").toLocalIterator():
        words = words_of(r["t"])
        if words:
            block.append((r["i"], words))
            size += len(r["t"])
        if size >= limit:
            yield block
            block, size = [], 0
    if block or not size:
        yield block


def search_windows(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, items)`` for each document row of the index.

    With one block of items, which is the usual case, this is a map over the
    segments.  Further blocks are searched in turn, one broadcast at a time; a
    document's hits are the union over the blocks, combined by position in its
    stored segment.
    """
    spark = index.sparkSession
    columns = index.select("segment", *COLUMNS)
    results = []
    blocks = item_blocks(items, id_col, text_col)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        sent = spark.sparkContext.broadcast(block)
        return arrow_map(columns, _search(lambda: sent.value, width), RESULT).drop("marks", "segment", "row")
    while block is not None:
        sent = spark.sparkContext.broadcast(block)
        results.append(written(arrow_map(columns, _search(lambda sent=sent: sent.value, width, keep_marks=True), RESULT), "hits"))
        sent.unpersist()
        block, after = after, next(blocks, None)
    union = results[0]
    for r in results[1:]:
        union = union.union(r)
    # One row of each block for each document.
    merged = union.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("marks").alias("marks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def combine(batches):
        for b in batches:
            hit = [int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in marks])).sum()) for marks in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), b.column(3)], ["doc_id", "n_words", "n_hit", "items"])

    return arrow_map(merged.select("doc_id", "n_words", "marks", "items"), combine, "doc_id long, n_words long, n_hit long, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """One row for each document row: words, hit words, items and their digest."""
    index = build_index(docs, id_col, text_col)
    found = search_windows(index, items, item_id, item_text, width)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def search_proximity(index: DataFrame, queries: list[tuple[str, list[str]]], span: int) -> DataFrame:
    """``(query, doc_id, first, last)``: where all terms lie within ``span`` words.

    From each posting of the rarest term the nearest postings of the others in
    the window around it are sought; the closest window of a document is kept.
    """
    asked = [(name, [t.lower().encode() for t in terms]) for name, terms in queries]

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for r in range(b.num_rows):
                s = Segment.at(b, r)
                starts = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                for name, terms in asked:
                    lists = sorted((s.postings(t) for t in set(terms)), key=len)
                    if not lists or not len(lists[0]):
                        continue
                    best: dict[int, tuple] = {}
                    for p in lists[0].tolist():
                        d = int(np.searchsorted(s.ends, p, "right"))
                        for left in range(max(int(starts[d]), p - span + 1), p + 1):
                            right = min(left + span, int(s.ends[d]))
                            held = [x[np.searchsorted(x, left) : np.searchsorted(x, right)] for x in lists]
                            if all(len(x) for x in held):
                                first = max(left, min(int(x[0]) for x in held))
                                last = max(int(x[0]) for x in held)
                                if last - first < best.get(d, (span,))[0]:
                                    best[d] = (last - first, first - int(starts[d]), last - int(starts[d]))
                    for d, (_, first, last) in best.items():
                        for o, v in zip(out, (name, s.doc_ids[d], first, last)):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], ["query", "doc_id", "first", "last"])

    return arrow_map(index.select(*COLUMNS), run, "query string, doc_id long, first long, last long")


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of an item, columns unchanged.

    The segments are built and searched in the task that holds the rows, so
    the texts are not joined with the result.  Blocks of items are searched in
    turn, one broadcast at a time; what a block leaves is written for the next.
    """
    spark = docs.sparkSession
    ids, texts = docs.columns.index(id_col), docs.columns.index(text_col)

    def without(rows: DataFrame, block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            asked = sent.value
            for b in batches:
                named = pa.RecordBatch.from_arrays([b.column(ids).cast(pa.int64()), b.column(texts)], ["i", "t"])
                clean: list[bool] = []
                for segment in _segments([named]):
                    for found in _search(lambda: asked, width)([segment]):
                        clean += [n == 0 for n in found.column(2).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        return arrow_map(rows, run, docs.schema)

    blocks = item_blocks(items, item_id, item_text)
    out, after = without(docs, next(blocks)), next(blocks, None)
    while after is not None:
        out, after = without(written(out, "clean"), after), next(blocks, None)
    return out
