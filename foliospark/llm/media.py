"""Media columns by content-defined chunking.

A payload is cut where a rolling gear hash of its bytes has zero low bits.  The
hash of 32 bytes is a sum of shifted table values, so it is computed for a
whole slice by five doubling steps instead of byte by byte.  Chunks are named
by digest.  A chunk digest that occurs once in the corpus stays with its
payload; shared chunks go to a store with one row a digest.  A payload is stored
as a container: a header, the ordered chunk list with a mark for each chunk that
is in the store, and the chunks it keeps.  Containers and chunk store are written
tables.  Reading opens the stored containers, joins the marked chunks by digest,
checks every chunk and puts them together in list order; a chunk that is missing
or damaged is an error.  ``media_bytes`` and ``media_sha256`` are those of the
stored container, so a payload whose chunks are shared takes a few bytes.

Which digests are shared is counted over all chunks (digests only are
shuffled) and sent as a Bloom filter of bounded size; false positives merely
take the store's way.

Defined cases: a null text is an empty payload, which like every text is padded
with bytes 255 to a positive multiple of 576; null ids pass through; repeated
rows give repeated rows and equal texts equal values; a very long text has many
chunks and one container; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, arrow_map, slices, written

BLOCK = 576
TAIL_PIXELS = 32
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 512, 11, 8192
MAGIC = b"CDC1"

# The gear table: a fixed pseudo-random value for each byte.
GEAR = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload(text: str | None) -> tuple[bytes, int]:
    """Padded bytes and the unpadded length."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK), len(raw)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the last 32 bytes, modulo 2**32."""
    h = GEAR[data]
    width = 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks: the first hash cut after the least size, or the greatest size."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    marks = np.flatnonzero(gear_hashes(np.frombuffer(data, np.uint8)) & np.uint32((1 << MEAN_BITS) - 1) == 0) + 1
    ends, at = [], 0
    while n - at > MIN_CHUNK:
        k = int(np.searchsorted(marks, at + MIN_CHUNK))
        end = min(int(marks[k]) if k < len(marks) else n, at + MAX_CHUNK, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk in order."""
    out, at = [], 0
    for end in cut_points(data):
        part = data[at:end]
        out.append((digest(part), part))
        at = end
    return out


ENTRY = struct.Struct("<16sIB")
"""An entry of the chunk list: digest, length, and 1 if the chunk is in the store."""


def store(parts: list[tuple[bytes, bytes]], shared: list[bool] | None = None) -> bytes:
    """The container: header, ordered chunk list, and the 8-bit samples of the chunks that are not ``shared``."""
    shared = shared or [False] * len(parts)
    listed = b"".join(ENTRY.pack(d, len(c), s) for (d, c), s in zip(parts, shared))
    return MAGIC + struct.pack(">I", len(parts)) + listed + b"".join(c for (_, c), s in zip(parts, shared) if not s)


def load(stored: bytes, fetched: dict[bytes, bytes] | None = None) -> bytes:
    """The payload of a container; raises if a chunk is missing or does not match its digest."""
    if stored[:4] != MAGIC:
        raise ValueError("not a chunk container")
    (n,) = struct.unpack_from(">I", stored, 4)
    at, out = 8 + ENTRY.size * n, []
    for i, (d, size, shared) in enumerate(ENTRY.iter_unpack(stored[8:at])):
        if shared:
            part = (fetched or {}).get(d)
            if part is None:
                raise ValueError(f"chunk {i} is not in the store")
        else:
            part = stored[at : at + size]
            at += size
        if len(part) != size or digest(part) != d:
            raise ValueError(f"chunk {i} does not match its digest")
        out.append(part)
    return b"".join(out)


FEATURES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
FEATURE_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(doc_id, n_bytes: int, stored: bytes, fetched: dict[bytes, bytes] | None = None) -> tuple:
    """Features of the payload read back from its container."""
    data = load(stored, fetched)
    samples = np.frombuffer(data, np.uint8)
    edges = np.bincount(samples >> 5, minlength=8)
    feature = f"{int(samples.sum())}:{'-'.join(map(str, edges.tolist()))}:{struct.unpack_from('>I', stored, 4)[0]}"
    return doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-TAIL_PIXELS:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def _name(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def chunk_names(docs: DataFrame) -> DataFrame:
    """``(name)`` of every chunk occurrence; the name is the digest's first 64 bits."""

    def run(batches):
        for b in batches:
            names = [_name(d) for t in b.column(0).to_pylist() for d, _ in chunks(payload(t)[0])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64())], ["name"])

    return arrow_map(docs.select("text"), run, "name long")


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The stored media: containers ``(doc_id, n_bytes, name, gaps, container)`` and chunk store ``(digest, chunk)``.

    A container's name is the digest of its bytes; ``gaps`` counts its chunks in the store.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = written(chunk_names(rows).groupBy("name").count().filter("count > 1").select("name"), "shared")
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(shared, "name"))

    def split(batches):
        """A row for each container, and one for each shared chunk of the task."""
        known, sent = bloom.value, set()
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i, j in slices(texts):
                cut = [payload(t) for t in texts[i:j]]
                parts = [chunks(data) for data, _ in cut]
                flags, at = known.has(np.array([_name(d) for p in parts for d, _ in p], np.int64)).tolist(), 0
                containers, gaps, chunk_rows = [], [], {}
                for p in parts:
                    own = flags[at : at + len(p)]
                    at += len(p)
                    containers.append(store(p, own))
                    gaps.append(sum(own))
                    chunk_rows.update((d, c) for (d, c), f in zip(p, own) if f and d not in sent)
                sent.update(chunk_rows)
                if len(sent) > 200_000:
                    sent.clear()
                none = [None] * len(chunk_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids.slice(i, j - i), pa.array(none, ids.type)]),
                        pa.array([n for _, n in cut] + none, pa.int64()),
                        pa.array([digest(c) for c in containers] + list(chunk_rows), pa.binary()),
                        pa.array(gaps + none, pa.int32()),
                        pa.array(containers + list(chunk_rows.values()), pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "name", "gaps", "bytes"],
                )

    both = written(arrow_map(rows, split, "doc_id long, n_bytes long, name binary, gaps int, bytes binary"), "media")
    chunk_store = written(both.filter("gaps is null").groupBy(F.col("name").alias("digest")).agg(F.first("bytes").alias("chunk")), "chunks")
    return both.filter("gaps is not null").withColumnRenamed("bytes", "container"), chunk_store


def read_payloads(containers: DataFrame, chunk_store: DataFrame) -> DataFrame:
    """Features of every payload, read back from its container and the chunk store."""

    def whole(batches):
        for b in batches:
            ids, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield _rows([features(i, n, c.as_py()) for i, n, c in zip(ids, sizes, b.column(2))], FEATURES, FEATURE_KINDS)

    complete = arrow_map(containers.filter("gaps = 0").select("doc_id", "n_bytes", "container"), whole, FEATURE_SCHEMA)
    gapped = containers.filter("gaps > 0")
    # Equal containers are read back once.
    heads = written(gapped.groupBy("name").agg(F.first("container").alias("container")), "heads")
    listed = F.expr(f"substring(container, 9, {ENTRY.size} * cast(conv(hex(substring(container, 5, 4)), 16, 10) as int))")
    entries = F.expr(f"filter(transform(sequence(0, cast(length(listed) / {ENTRY.size} as int) - 1), i -> substring(listed, i * {ENTRY.size} + 1, {ENTRY.size})), e -> substring(e, {ENTRY.size}, 1) = X'01')")
    wanted = heads.select("name", listed.alias("listed")).select("name", F.explode(entries).alias("entry")).select("name", F.expr("substring(entry, 1, 16)").alias("digest")).distinct()
    fetched = wanted.join(chunk_store, "digest").select("name", F.col("digest").alias("a"), F.col("chunk").alias("b"))
    head = heads.select("name", F.lit(None).cast("binary").alias("a"), F.col("container").alias("b"))

    def read_back(batches):
        """Rows by container, itself first: its payload is put together at the next one."""
        name, stored, held = None, None, {}

        def close():
            return [(name, *features(None, 0, stored, held)[2:])] if stored is not None else []

        for batch in batches:
            out = []
            for key, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if a is None:
                    out += close()
                    name, stored, held = key, b, {}
                else:
                    held[a] = b
            yield _rows(out, KEYED, KEYED_KINDS)
        yield _rows(close(), KEYED, KEYED_KINDS)

    together = head.unionByName(fetched).repartition("name").sortWithinPartitions("name", F.col("a").asc_nulls_first())
    read = arrow_map(together, read_back, "name binary, " + FEATURE_SCHEMA.split(", ", 2)[2])
    return complete.unionByName(gapped.select("doc_id", "n_bytes", "name").join(read, "name").select(*FEATURES))


KEYED, KEYED_KINDS = ["name", *FEATURES[2:]], [pa.binary(), *FEATURE_KINDS[2:]]


def _rows(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every payload, read it back and compute its features."""
    return read_payloads(*store_payloads(docs, id_col, text_col))
