"""Shared plumbing of the corpus operators: tables, scratch storage, Arrow slices.

Every operator takes the columns it needs by name and ignores the rest, so
extra columns never clash with an operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import scratch_root, written

__all__ = ["Bloom", "arrow_map", "fresh", "row_keys", "row_sample", "scratch_root", "slices", "table", "written"]

BATCH_ROWS = 1_000
BATCH_BYTES = 32 << 20
SLICE_BYTES = 4 << 20
"""Text is handled in slices of about this many characters inside a task."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read only through Spark (any store Spark can reach)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, label: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its names."""
    taken, name = {c.lower() for c in df.columns}, f"__{label}"
    while name.lower() in taken:
        name += "_"
    return name


def row_sample(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by row number and not by content, so equal rows are sampled like others."""
    step = max(1, df.count() // rows)
    if step == 1:
        return df
    number = fresh(df, "row")
    return df.withColumn(number, F.monotonically_increasing_id()).filter(F.pmod(F.xxhash64(number), F.lit(step)) == 0).drop(number)


def row_keys(df: DataFrame) -> list:
    """Two 64-bit hashes of all columns: rows that agree in both are taken as equal rows."""
    cells = [F.col(f"`{c}`") for c in df.columns]
    return [F.xxhash64(*cells, F.lit(seed)) for seed in (1, 2)]


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over small batches, so a worker holds few texts at a time.

    Where the session has no batch settings of its own, small ones are set;
    those that a caller has made stay, and their batches are taken in parts.
    """
    ship(df.sparkSession)
    conf, own = df.sparkSession.conf, df.sparkSession._jsparkSession.sessionState().conf()
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not own.contains(key):
            conf.set(key, str(value))

    def parts(batches):
        return run(b.slice(at, BATCH_ROWS) for b in batches for at in range(0, max(1, b.num_rows), BATCH_ROWS))

    return df.mapInArrow(parts, schema)


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``limit`` characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class Bloom:
    """A Bloom filter of bounded size over 64-bit hashes, built by a shuffle of words.

    Two 32-bit halves of a hash are its positions.  Beyond ``max_bits / 16``
    hashes it only lets more through; what it lets through is always checked by
    a join, so results never depend on it.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, hashes: DataFrame, column: str, max_bits: int = 1 << 25) -> Bloom:
        n = hashes.count()
        bits = 1 << 10
        while bits < min(16 * n, max_bits):
            bits *= 2
        at = F.explode(F.array(F.col(column).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(F.col(column), 32).bitwiseAND(F.lit(bits - 1))))
        place = hashes.select(at.alias("p")).select(F.shiftright("p", 5).alias("w"), F.expr("shiftleft(1, cast(p & 31 as int))").alias("b"))
        table = place.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(bits // 32, np.uint32)
        words[table.column("w").to_numpy()] = table.column("b").to_numpy().astype(np.int32).view(np.uint32)
        return cls(words, bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes (int64) may be in the set."""
        u, mask = h.view(np.uint64), np.uint64(self.bits - 1)
        out = np.ones(len(h), bool)
        for p in (u & mask, (u >> np.uint64(32)) & mask):
            out &= (self.words[p >> np.uint64(5)] >> (p & np.uint64(31)).astype(np.uint32)) & 1 == 1
        return out
