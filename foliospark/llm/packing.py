"""Sequence packing as a cutting-stock problem solved by column generation.

1. One pass over the texts turns each document into pieces: full sequences of
   ``capacity`` tokens and one rest.  Only ids, lengths and CRCs leave it.
2. The rests' lengths, rounded up to a grid, form a histogram of at most
   ``capacity / grid`` classes; that bounded table is all the driver gets.
3. A linear program over patterns (how many rests of each class share one
   sequence) is solved by the revised simplex method; a knapsack dynamic
   program prices new patterns.  Patterns are rounded down, and what is left
   of each class is packed first-fit decreasing into further patterns.
4. Rests are ranked within their class by salted prefix counts (never by a
   window over a whole class), and a rank determines pattern, sequence and
   slot by arithmetic on a bounded table.

Defined cases: null and empty texts are the end id alone; repeated rows are
packed each for itself and dealt out by a stored row number, so any number of
equal rows spreads over the salts; ties in length are broken by salt, id, start
and row number; very long texts are cut into full sequences and a rest; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import arrow_map, slices, written

CAPACITY = 4096
GRID = 8
END_ID = 2
ROWS_PER_SALT = 400
MAX_SALTS = 4_096
BROADCAST_ROWS = 1 << 17
PIECES = "doc_id long, row_no long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: whole sequences, then a rest."""
    end = np.asarray([END_ID], "<u4").tobytes()
    width = 4 * capacity
    key = ("ids", path)

    def run(batches):
        encoder = Encoder.of_worker(key, path)
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            doc, row, start, length, crc, total = out
            for i, j in slices(texts):
                for k, tokens in enumerate(encoder.encode(texts[i:j]), i):
                    tokens += end
                    n = len(tokens) // 4
                    for at in range(0, len(tokens), width):
                        part = tokens[at : at + width]
                        doc.append(ids[k])
                        c = zlib.crc32(part)
                        row.append(number)
                        number += 1
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(c)
                        total.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "row_no", "start", "length", "ids_crc32", "doc_tokens"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, PIECES)


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the pattern of the greatest dual value."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, np.int64)
    useful = np.flatnonzero(duals > 1e-12)  # sizes ascend
    order, values = sizes[useful], duals[useful]
    fits = np.searchsorted(order, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            got = best[c - order[:k]] + values[:k]
            k = got.argmax()
            if got[k] > best[c] + 1e-12:
                best[c], last[c] = got[k], useful[k]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), pattern


def start_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns that use up one class after another, largest first; one column a class.

    A pattern is filled greedily from the classes that are left and used until
    one of them is gone; its column takes that class's place.  No later pattern
    holds that class, so the columns form a triangular, feasible basis.
    """
    left = demand.copy()
    columns = np.zeros((len(sizes), len(sizes)))
    open_classes = set(range(len(sizes)))
    while open_classes:
        room, pattern = capacity, np.zeros(len(sizes))
        for i in sorted(open_classes, reverse=True):
            if sizes[i] <= room and (k := int(min(room // sizes[i], max(1.0, np.floor(left[i]))))):
                pattern[i], room = k, room - k * sizes[i]
                if room < sizes[0]:
                    break
        held = np.flatnonzero(pattern)
        use = (left[held] / pattern[held]).min()
        left[held] -= use * pattern[held]
        gone = [i for i in held if left[i] <= 1e-9]
        columns[:, gone[0]] = pattern
        for i in gone[1:]:
            columns[i, i] = capacity // sizes[i]
        open_classes.difference_update(gone)
    return columns


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-5, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """The linear program by column generation: patterns and how often each is used.

    Revised simplex on an explicit basis inverse, refreshed now and then,
    starting from ``start_basis``.
    Duals divided by their best pattern's value are feasible, which bounds the
    optimum from below; the search ends within ``gap`` of it or half a sequence.  ``rounds``
    bounds the pivots; stopping early costs padding, not correctness.
    """
    m = len(sizes)
    columns = start_basis(sizes, demand, capacity)
    inverse = np.linalg.inv(columns)
    x = inverse @ demand
    centre, bound = sizes / capacity, float(sizes @ demand) / capacity
    for step in range(rounds):
        if x.sum() - bound <= max(gap * bound, 0.5):
            break
        duals = inverse.sum(axis=0)
        # Duals jump about, so patterns are priced near those of the best bound so far.
        for weight in (0.85, 0.0):
            mixed = np.maximum(weight * centre + (1 - weight) * duals, 0)
            value, pattern = price(mixed, sizes, capacity)
            if float(mixed @ demand) / value > bound:
                centre, bound = mixed / value, float(mixed @ demand) / value
            if duals @ pattern > 1 + 1e-7:
                break
        else:
            break
        u = inverse @ pattern
        grows = u > 1e-9
        if not grows.any():
            break
        ratio = np.where(grows, x / np.where(grows, u, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        columns[:, out] = pattern
        row = inverse[out] / u[out]
        inverse -= np.outer(u, row)
        inverse[out] = row
        x = x - theta * u
        x[out] = theta
        if step % 200 == 199:
            inverse = np.linalg.inv(columns)
            x = inverse @ demand
        x = np.maximum(x, 0)
    return [(columns[:, j].astype(np.int64), float(x[j])) for j in range(m) if x[j] > 1e-9]


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """First-fit decreasing over the items left after rounding."""
    rooms, packed = np.zeros(0, np.int64), []
    for i in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[i])):
            fit = np.flatnonzero(rooms >= sizes[i])
            if len(fit):
                k = int(fit[0])
            else:
                k = len(packed)
                rooms = np.append(rooms, capacity)
                packed.append(np.zeros(len(sizes), np.int64))
            rooms[k] -= sizes[i]
            packed[k][i] += 1
    return packed


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``{class: items}`` with whole use counts that cover the histogram exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    left, out = demand.copy(), []
    for pattern, use in sorted(solve(sizes, demand.astype(float), capacity), key=lambda p: -p[1]):
        held = pattern > 0
        n = min(int(use + 1e-6), int((left[held] // pattern[held]).min()))
        if n > 0:
            left -= n * pattern
            out.append((pattern, n))
    out += [(p, 1) for p in first_fit(sizes, left, capacity)]
    return [({int(sizes[i]): int(p[i]) for i in np.flatnonzero(p)}, n) for p, n in out]


def planned(spark: SparkSession, histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``plan``, run by one worker: it is a task of bounded size, and workers keep matrix products to one thread."""

    def run(batches):
        given: dict[int, int] = {}
        for b in batches:
            given.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        rows = [(i, size, k, n) for i, (pattern, n) in enumerate(plan(given, capacity)) for size, k in pattern.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["pattern", "size", "items", "uses"])

    classes = spark.createDataFrame(sorted(histogram.items()), "size long, n long").coalesce(1)
    found: dict[int, tuple[dict[int, int], int]] = {}
    for r in arrow_map(classes, run, "pattern long, size long, items long, uses long").collect():
        found.setdefault(r["pattern"], ({}, r["uses"]))[0][r["size"]] = r["items"]
    return [found[i] for i in sorted(found)]


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By class: rows (first rank, items in a sequence, first sequence) in rank order."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, n in patterns:
        for size, k in pattern.items():
            rows.setdefault(size, []).append((used.get(size, 0), k, base))
            used[size] = used.get(size, 0) + n * k
        base += n
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def looked_up(values: list[int], at: Column) -> Column:
    """``values[at]``: one literal array, which constant folding builds once."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>"), at + 1)


def salts_for(rows: int) -> int:
    return max(1, min(MAX_SALTS, -(-rows // ROWS_PER_SALT)))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, grid: int = GRID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their sequence and offset; offsets are gapless from 0."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity, id_col, text_col), "pieces")
    size = F.ceil(F.col("length") / F.lit(float(grid))).cast("int")
    rest = cut.filter(F.col("length") < capacity).withColumn("size", size)
    full = cut.filter(F.col("length") == capacity)

    histogram = {r["size"]: r["count"] for r in rest.groupBy("size").count().collect()}
    patterns = planned(spark, histogram, capacity // grid)
    made = sum(n for _, n in patterns)
    assigned = spark.sparkContext.broadcast(slots(patterns))

    spread = {s: salts_for(n) for s, n in histogram.items()}
    salts = looked_up([spread.get(s, 1) for s in range(capacity // grid + 1)], F.col("size"))
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("row_no"), salts).cast("int"))
    within = Window.partitionBy("size", "salt").orderBy("doc_id", "start", "row_no")
    ranked = salted.withColumn("local", F.row_number().over(within) - 1)
    per_salt = salted.groupBy("size", "salt").count()
    before = per_salt.withColumn("before", F.sum("count").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("size", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = ranked.join(F.broadcast(before) if sum(spread.values()) <= BROADCAST_ROWS else before, ["size", "salt"])

    def place(batches):
        table = assigned.value
        for b in batches:
            sizes, ranks = b.column(0).to_numpy(), b.column(1).to_numpy()
            seq, slot = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            order = np.argsort(sizes, kind="stable")
            ends = np.flatnonzero(np.diff(sizes[order], append=-1)) + 1
            for at in np.split(order, ends[:-1]) if len(order) else []:
                rows = table[int(sizes[at[0]])]
                r = ranks[at]
                k = np.searchsorted(rows[:, 0], r, "right") - 1
                seq[at] = rows[k, 2] + (r - rows[k, 0]) // rows[k, 1]
                slot[at] = (r - rows[k, 0]) % rows[k, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(2, b.num_columns)), pa.array(seq), pa.array(sizes.astype(np.int64)), pa.array(slot)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "size", "slot"])

    placed = arrow_map(ranked.select("size", (F.col("before") + F.col("local")).alias("rank"), "doc_id", "start", "length", "ids_crc32", "doc_tokens"), place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, size long, slot long")
    # A sequence holds `capacity` pieces at most, so these groups are bounded.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    rests = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))

    # Full pieces: sequence numbers after the patterns', by salted counts again.
    lots = salts_for(full.count())
    dealt = full.withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(lots)).cast("int"))
    counts = {r["salt"]: r["count"] for r in dealt.groupBy("salt").count().collect()}
    first = looked_up(list(accumulate((counts.get(s, 0) for s in range(lots - 1)), initial=made)), F.col("salt"))
    alone = dealt.withColumn("sequence_id", first + F.row_number().over(Window.partitionBy("salt").orderBy("doc_id", "start", "row_no")) - 1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id")]
    return rests.select(*columns, F.col("offset").cast("long").alias("offset")).unionByName(alone.select(*columns, F.lit(0).cast("long").alias("offset")))
