"""Connected components of an edge table by alternating minimum stars.

Large star: every node hands the smallest id in its neighbourhood to its larger
neighbours.  Small star: it hands that id to its smaller neighbours and itself.
Both are grouped minima, which pre-aggregate before the shuffle, followed by an
equi-join whose build side has one row a node; no neighbourhood is gathered in
one task, so a hub that holds a third of all nodes is no bottleneck.  Each round
is written to the shared folder, so its lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def _towards_minimum(pairs: DataFrame, least: DataFrame, smaller: bool) -> DataFrame:
    """``(v, min(u))`` for the pairs ``(u, v)`` on one side of u."""
    side = pairs.filter(F.col("v") < F.col("u")) if smaller else pairs.filter(F.col("v") > F.col("u"))
    return side.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge; component: its smallest node.

    Null ends and loops are dropped; repeated and reversed edges are harmless;
    no edges give no rows.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") > F.col("v"))).distinct()
    e = written(e, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _towards_minimum(both, least, smaller=False).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _towards_minimum(large, least, smaller=True).filter("u > v").union(least.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
