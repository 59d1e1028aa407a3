"""SimHash near-duplicates found exactly through distributed vantage-point trees.

Fingerprints within ``radius`` 3 of 64 bits differ by at most 1 bit in one of
their two 32-bit halves.  For each half a vantage-point tree is fitted on a
bounded sample: a node has a vantage point and a median distance.  Every
fingerprint has one home leaf.  As a query it also visits each leaf that its
ball of radius 1 reaches: by the triangle inequality a branch is pruned if the
distance to the vantage point lies further than 1 from the branch's side.  A
leaf is a shard; a crowded leaf is dealt out over a grid of tasks, each with a
part of the homes and a part of the visitors, so a task's memory is bounded.  Inside a shard pairs are compared by
popcount on ranges that the triangle bound leaves, and a union-find reduces
what links to a star for each local component, so a large group of near copies
yields one row a fingerprint and never all pairs.  Components join the stars.

Equal fingerprints are collapsed before, so exact copies cost one row.

Defined cases: null or wordless texts have fingerprint zero and link like any
other; null ids take part but never name a component, unless all of its ids
are null (then null); repeated rows give repeated result rows; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh, row_keys, slices, written
from .components import connected_components

RADIUS = 3
LEAF_ROWS = 4_096
SAMPLE_ROWS = 1 << 16
"""Fingerprints to which the trees are fitted, about; eight for each leaf where that is more."""
MAX_DEPTH = 18
"""Leaves hold ``LEAF_ROWS`` up to 2**30 distinct fingerprints; beyond, their grids grow."""
HOME_ROWS = 16_384
"""Homes of one leaf in one task at most, on average; a crowded leaf is dealt out."""

_LOW = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Majority-bit fingerprints (uint64) of the texts' word shingles."""
    from xxhash import xxh64_intdigest

    hashes, counts = [], []
    join = b" ".join
    for t in texts:
        w = t.encode().lower().split() if t else []  # bytes: only A-Z and ASCII white space
        if len(w) >= shingle:
            hashes.append(np.fromiter(map(xxh64_intdigest, map(join, zip(*(w[k:] for k in range(shingle)))), repeat(seed)), np.uint64, len(w) - shingle + 1))
        elif w:
            hashes.append(np.array([xxh64_intdigest(join(w), seed)], np.uint64))
        counts.append(len(hashes[-1]) if w else 0)
    out = np.zeros(len(texts), np.uint64)
    n = np.array(counts, np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    h, n = np.concatenate(hashes), n[full]
    # Bits are summed in bytes: blocks of up to 255 hashes, then blocks by text.
    blocks = -(-n // 255)
    ends = np.cumsum(n)
    first = ends - n
    owner = np.repeat(np.arange(len(n)), blocks)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = first[owner] + 255 * inner
    block_of = np.cumsum(blocks) - blocks
    bits = np.zeros(len(n), np.uint64)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & _LOW, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        totals = np.add.reduceat(sums.astype(np.int64), block_of, axis=0)
        for byte in range(8):
            bits |= (2 * totals[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = bits
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp)``; fp is the fingerprint as a signed long.  ``keys`` are long columns that become key1, key2, ..."""
    named = [f"key{i}" for i in range(1, len(keys) + 1)]

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = [fingerprints_of(texts[i:j], shingle) for i, j in slices(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)), *b.columns[2:]], ["doc_id", "fp", *named])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(keys, named)])
    return arrow_map(rows, run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *named)))


class Tree:
    """A vantage-point tree over 32-bit values in heap layout; bounded by its depth."""

    def __init__(self, depth: int, sample: np.ndarray, seed: int = 7):
        self.depth = depth
        nodes = (1 << depth) - 1
        self.point = np.zeros(nodes, np.uint32)
        self.median = np.full(nodes, 32, np.int16)
        rng = np.random.default_rng(seed)
        parts = {0: sample.astype(np.uint32)}
        for node in range(nodes):
            x = parts.pop(node, None)
            if x is None or len(x) < 2:
                continue
            best = None
            for p in rng.choice(x, min(12, len(x)), replace=False):
                hist = np.bincount(np.bitwise_count(x ^ p), minlength=35)
                inside = np.cumsum(hist)
                # Rows on both sides are those at the median and just beyond.
                cost = np.maximum(inside, len(x) - inside)[:33] + hist[:33] + hist[1:34]
                m = int(cost.argmin())
                if best is None or cost[m] < best[0]:
                    best = (cost[m], p, m)
            _, self.point[node], self.median[node] = best
            near = np.bitwise_count(x ^ self.point[node]) <= self.median[node]
            parts[2 * node + 1], parts[2 * node + 2] = x[near], x[~near]

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            far = np.bitwise_count(x ^ self.point[node]) > self.median[node]
            node = 2 * node + 1 + far
        return node - ((1 << self.depth) - 1)

    def visits(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (row, leaf) that the balls of ``radius`` around ``x`` reach."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(x[row] ^ self.point[node]).astype(np.int16)
            m = self.median[node]
            near, far = d - radius <= m, d + radius > m
            row, node = np.concatenate([row[near], row[far]]), np.concatenate([2 * node[near] + 1, 2 * node[far] + 2])
        return row, node - ((1 << self.depth) - 1)


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = fps.view(np.uint64)
    return (u >> np.uint64(32)).astype(np.uint32), (u & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def local_stars(homes: np.ndarray, visitors: np.ndarray, radius: int = RADIUS, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(fp, root)`` that span all links between homes and visitors (uint64).

    Visitors are sorted by their distance to a vantage point; a block of homes
    meets only those whose distance differs by ``radius`` at most.
    """
    none = np.zeros(0, np.uint64)
    if not len(homes) or len(visitors) < 2:
        return none, none
    nodes = np.unique(np.concatenate([homes, visitors]))
    parent = np.arange(len(nodes))

    def roots(i: np.ndarray) -> np.ndarray:
        r = parent[i]
        while True:
            up = parent[r]
            if (up == r).all():
                parent[i] = r
                return r
            r = up

    vantage = homes[0]
    dv = np.bitwise_count(visitors ^ vantage)
    order = np.argsort(dv, kind="stable")
    v, dv = visitors[order], dv[order]
    dh = np.bitwise_count(homes ^ vantage)
    order = np.argsort(dh, kind="stable")
    h, dh = homes[order], dh[order]
    place = np.searchsorted(nodes, v)
    for at in range(0, len(h), block):
        part, d = h[at : at + block], dh[at : at + block]
        lo, hi = np.searchsorted(dv, int(d[0]) - radius, "left"), np.searchsorted(dv, int(d[-1]) + radius, "right")
        close = np.bitwise_count(part[:, None] ^ v[None, lo:hi]) <= radius
        own = np.searchsorted(nodes, part)
        for k in np.flatnonzero(close.sum(axis=1) > 1):
            r = np.unique(roots(np.append(place[lo:hi][close[k]], own[k])))
            parent[r] = r[0]
    root = roots(np.arange(len(nodes)))
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def links(fps: DataFrame, leaf_rows: int = LEAF_ROWS, home_rows: int = HOME_ROWS) -> DataFrame:
    """Spanning edges ``(src, dst)`` of the graph of distinct fingerprints within radius 3."""
    spark = fps.sparkSession
    n = fps.count()
    depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(1, n / leaf_rows))))))
    most = max(SAMPLE_ROWS, 8 << depth)
    # Fingerprints are distinct here, so a hash of them samples evenly.
    sample = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // most))) == 0).limit(2 * most).toArrow().column(0).to_numpy()
    trees = spark.sparkContext.broadcast([Tree(depth, x) for x in _halves(sample)])

    def homes(batches):
        count = np.zeros(2 << depth, np.int64)
        for b in batches:
            for half, x in enumerate(_halves(b.column(0).to_numpy())):
                count += np.bincount(trees.value[half].home(x) + (half << depth), minlength=2 << depth)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used])], ["leaf", "n"])

    crowd = np.ones(2 << depth, np.int64)  # parts of each leaf
    for r in arrow_map(fps, homes, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        crowd[r["leaf"]] = -(-r["n"] // home_rows)
    parts = spark.sparkContext.broadcast(crowd)

    def route(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            mixed = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            out = [[], [], [], []]
            for half, x in enumerate(_halves(fp)):
                tree = trees.value[half]
                home = tree.home(x)
                row, leaf = tree.visits(x, RADIUS // 2)
                k = parts.value[leaf + (half << depth)]
                own = (mixed[row] % k.astype(np.uint64)).astype(np.int64)
                at_home = home[row] == leaf
                # A visitor goes to its own column in every row of the leaf's grid, a home also to the rest of its own row.
                again = np.repeat(np.arange(len(row)), k)
                turn = np.arange(len(again)) - np.repeat(np.cumsum(k) - k, k)
                down, across = (again, turn, own[again]), (again, own[again], turn)
                also = at_home[again] & (turn != own[again])
                pick, r, c = (np.concatenate([x, y[also]]) for x, y in zip(down, across))
                lives = at_home[pick] & (own[pick] == r)
                for o, a in zip(out, (leaf[pick] + (half << depth), r * k[pick] + c, fp[row[pick]], lives)):
                    o.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["leaf", "part", "fp", "home"])

    def search(key, shard):
        fp = shard.column("fp").to_numpy().view(np.uint64)
        home = shard.column("home").to_numpy(zero_copy_only=False)
        src, dst = local_stars(fp[home], fp)
        return pa.table({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return arrow_map(fps, route, "leaf long, part long, fp long, home boolean").groupBy("leaf", "part").applyInArrow(search, "src long, dst long")


def _classes(prints: DataFrame) -> DataFrame:
    """``(fp, component)`` of every distinct fingerprint; a component is named by its least fingerprint."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = written(distinct, "distinct")
    member = written(connected_components(links(distinct.select("fp"))), "members")
    return distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``."""
    prints = written(fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    named = _classes(prints)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of each component stays: of the smallest id the row with the least hash of its columns.

    Rows are told apart by a hash of all their columns, so ids may repeat or be
    null; a row with an id comes before one without.  Of equal rows one stays.
    """
    first, second = fresh(docs, "key1"), fresh(docs, "key2")
    keyed = docs.withColumns(dict(zip((first, second), row_keys(docs))))
    prints = written(fingerprint(keyed, id_col, text_col, shingle, (first, second)), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("key1").alias("a"), F.col("key2").alias("b"))
    firsts = prints.groupBy("fp").agg(F.min(place).alias("first"))
    kept = firsts.join(_classes(prints).select("fp", "component"), "fp").groupBy("component").agg(F.min("first").alias("first"))
    wanted = kept.select(F.col("first.a").alias(first), F.col("first.b").alias(second))
    return keyed.join(wanted, [first, second], "left_semi").dropDuplicates([first, second]).select(*[F.col(f"`{c}`") for c in docs.columns])
