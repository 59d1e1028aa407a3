"""Merkle fixity audit of stored WARC replicas.

Pages become WARC resource records.  A replica is a written table of record
bytes: a record's name, the digest it had when it was written, gives its node, a
range of hashes, and neighbouring nodes share a file; in a file the records lie
in the order of node and name, one after the other.

An audit reads the bytes of both replicas back.  The hash of a node covers, in
order, the digests that the stored bytes have now, their copies, and their
offsets from the node's begin; up to ``FANOUT`` neighbours share a parent.
Replicas are compared from the root down: a level joins only the children of
nodes that differ, so sound replicas cost one comparison and a corrupt record one
path.  In the nodes that differ, records are joined by name.  A record that is
damaged, lost or added therefore concerns itself only; what lies behind it in the
file keeps its node, its offsets there and its hash.

Equal records are stored once with their number of copies.

Defined cases: null url or html count as empty; null ids are records like
others; repeated rows are one record with a count, which its node covers; one id
may have any number of different records, which spread over the nodes; very long
pages are one record each; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, written

FANOUT = 16
FILE_RECORDS = 2_048
"""Records of one WARC file, about; a file is a range of nodes."""

CRLF = "\r\n"


def record(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of one WARC resource record."""
    body = F.coalesce(body, F.lit("")).cast("binary")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2),
    )
    return F.concat(header.cast("binary"), body, F.lit(CRLF * 2).cast("binary"))


def levels_for(most: int) -> int:
    n = 0
    while FANOUT**n < max(1, most):
        n += 1
    return n


def geometry(pages: DataFrame, file_records: int = FILE_RECORDS) -> tuple[int, int]:
    """Levels above the nodes, and nodes of a file; nodes hold ``FANOUT`` rows at most on average."""
    n = pages.count()
    levels = max(0, levels_for(n) - 1)
    return levels, max(1, FANOUT**levels * file_records // max(1, n))


def _named(batches):
    """Records with their digest; a task sends the bytes of equal records once, and counts the others."""
    seen: Counter = Counter()
    for b in batches:
        names = [hashlib.sha256(x.as_py()).hexdigest() for x in b.column(1)]
        first = dict(zip(reversed(names), range(len(names) - 1, -1, -1)))
        new = sorted(i for n, i in first.items() if n not in seen)
        seen.update(names)
        kept = b.take(pa.array(new, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in new], pa.string()), pa.array([1] * len(new), pa.int64()), *kept.columns], ["name", "copies", "page_id", "raw", "body"])
    again = [(n, k - 1) for n, k in seen.items() if k > 1]
    none = lambda kind: pa.nulls(len(again), kind)
    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in again], pa.string()), pa.array([k for _, k in again], pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.int32())], ["name", "copies", "page_id", "raw", "body"])


def write_replica(pages: DataFrame, shape: tuple[int, int], id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """The stored files: ``(file, record_no, start, node, name, page_id, copies, body_at, raw)``, sorted by place.

    Record bytes are shuffled once, to their file; equal ones come once from each task.
    """
    levels, file_nodes = shape
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), record(F.col(id_col), F.col(url_col), F.col(body_col)).alias("raw"), F.octet_length(F.coalesce(F.col(body_col), F.lit(""))).alias("body"))
    rows = arrow_map(rows, _named, "name string, copies long, page_id long, raw binary, body int")
    rows = rows.withColumn("node", F.pmod(F.xxhash64("name"), F.lit(FANOUT**levels)).cast("long"))
    rows = rows.withColumn("file", F.floor(F.col("node") / file_nodes).cast("long")).repartition("file")
    whole = lambda c: F.first(c, ignorenulls=True).alias(c)
    rows = rows.groupBy("file", "node", "name").agg(whole("page_id"), F.sum("copies").alias("copies"), whole("body"), whole("raw"))
    size = F.octet_length("raw").cast("long")
    order = Window.partitionBy("file").orderBy("node", "name")
    start = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    # A record ends with its body and two line breaks.
    placed = rows.select("file", (F.row_number().over(order) - 1).cast("long").alias("record_no"), start.alias("start"), "node", "name", "page_id", "copies", (size - F.col("body") - 4).alias("body_at"), "raw")
    return written(placed, "warc")


def records(replica: DataFrame) -> DataFrame:
    """What the stored bytes are now: their length and digest, without the bytes."""
    return replica.withColumns({"length": F.octet_length("raw").cast("long"), "digest": F.sha2("raw", 256)}).drop("raw")


def nodes(rows: DataFrame) -> DataFrame:
    """``(node, hash)`` over the ordered digests, copies and offset ranges of each node's records."""
    held = F.array_sort(F.collect_list(F.struct("name", "start", "length", "digest", "copies")))
    parts = F.transform("held", lambda r: F.concat_ws(":", (r["start"] - F.col("base")).cast("string"), r["length"].cast("string"), r["digest"], r["copies"].cast("string")))
    return rows.groupBy("node").agg(held.alias("held"), F.min("start").alias("base")).select("node", F.sha2(F.array_join(parts, "|").cast("binary"), 256).alias("hash"))


def parents(children: DataFrame) -> DataFrame:
    """One level up: the hashes of up to FANOUT neighbours with their places."""
    kids = F.array_sort(F.collect_list(F.struct("node", "hash")))
    up = children.groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(kids.alias("kids"))
    covered = F.transform("kids", lambda k: F.concat_ws(":", k["node"].cast("string"), k["hash"]))
    return up.select(F.col("up").alias("node"), F.sha2(F.array_join(covered, "|").cast("binary"), 256).alias("hash"))


def tree(rows: DataFrame, levels: int) -> list[DataFrame]:
    """Levels from the nodes to the root, each written once."""
    out = [written(nodes(rows), "merkle")]
    for _ in range(levels):
        out.append(written(parents(out[-1]), "merkle"))
    return out


def descend(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """``(node)``: the nodes that differ, reached from the root only."""
    differing = None
    for a, b in zip(reversed(left), reversed(right)):
        if differing is not None:
            inside = lambda x: x.withColumn("up", F.floor(F.col("node") / FANOUT).cast("long")).join(differing.select(F.col("node").alias("up")), "up", "left_semi").drop("up")  # noqa: B023, E731
            a, b = inside(a), inside(b)
        pair = a.select("node", F.col("hash").alias("x")).join(b.select("node", F.col("hash").alias("y")), "node", "full_outer")
        differing = written(pair.filter(~F.col("x").eqNullSafe(F.col("y"))).select("node"), "differing")
    return differing


def compare(primary: DataFrame, replica: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Every record of either stored replica, with its place and whether the two differ in it.

    Both must have been written with ``shape``.  A record that only ``replica``
    has comes without a place and with 0 copies.
    """
    ours, theirs = (written(records(x), "records") for x in (primary, replica))
    bad = descend(tree(ours, shape[0]), tree(theirs, shape[0]))
    seen = theirs.join(bad, "node", "left_semi").select("name", F.col("page_id").alias("other_id"), F.col("length").alias("other_length"), F.col("digest").alias("other_digest"), F.col("copies").alias("replica_copies"))
    inside = ours.join(bad, "node", "left_semi").join(seen, "name", "full_outer")
    sound = F.coalesce((F.col("digest") == F.col("other_digest")) & (F.col("copies") == F.col("replica_copies")), F.lit(False))
    looked = inside.select(
        F.coalesce("page_id", "other_id").alias("page_id"), F.col("file").alias("warc_file"), "record_no", F.col("start").alias("record_offset"), F.coalesce("length", "other_length").alias("record_bytes"),
        F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("replica_copies", F.lit(0)).alias("replica_copies"), F.coalesce("digest", "other_digest").alias("record_sha256"), (~sound).alias("corrupt"),
    )
    rest = ours.join(bad, "node", "left_anti")
    same = rest.select("page_id", F.col("file").alias("warc_file"), "record_no", F.col("start").alias("record_offset"), F.col("length").alias("record_bytes"), "copies", F.col("copies").alias("replica_copies"), F.col("digest").alias("record_sha256"), F.lit(False).alias("corrupt"))
    return same.unionByName(looked)


def fixity(primary: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """Write the pages of both sides as replicas, read them back and ``compare`` them."""
    shape = geometry(primary, file_records)
    return compare(*(write_replica(x, shape, id_col, url_col, body_col) for x in (primary, replica)), shape)


def audit(primary: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """``fixity`` of the records that the primary has."""
    return fixity(primary, replica, id_col, url_col, body_col, file_records).filter("copies > 0").drop("replica_copies")
