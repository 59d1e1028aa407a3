"""Token counts: a two-tier map-side lookup without a pre-token shuffle.

Tier one is a broadcast table of the token counts of frequent pre-tokens: one
string of the pre-tokens and one byte a count.  It is fitted on a bounded sample
and holds at most ``table_words`` entries, so its size does not grow with the
data, and it only affects speed.  Tier two are caches in each Python worker,
filled by the library with what tier one lacks.  Each count is the library's own
count (see ``bpe.py``).

Defined cases: a null or empty text has 0 bytes and 0 tokens; null ids, ties
and repeated rows pass through, one row out for each row in; strings without a
break of any length are counted whole but not cached; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONGEST, Encoder, plain, pretokens
from .common import arrow_map, row_sample, slices, written

SAMPLE_ROWS = 4_000
TABLE_WORDS = 30_000


def _counted(batches):
    """The pre-tokens of each batch with their counts."""
    for b in batches:
        seen = Counter()
        for t in b.column(0).to_pylist():
            if t and plain(t):
                seen.update(p for p in pretokens(t) if len(p) <= LONGEST)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])


def frequent_pretokens(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, table_words: int = TABLE_WORDS) -> list[str]:
    """The most frequent pre-tokens of a sample of about ``sample_rows`` rows, ``table_words`` at most.

    The executors count and merge; the driver gets a histogram of the counts'
    sizes, from which it finds the least count that fits, and then what reaches it.
    """
    counts = written(arrow_map(row_sample(docs.select(text_col), sample_rows), _counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "pretokens")
    step = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > table_words:
            break
        least = r["step"]
    return sorted(r["token"] for r in counts.filter(step >= least).select("token").collect()) if least is not None else []


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, sample_rows: int = SAMPLE_ROWS, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc id, UTF-8 bytes, tokens and whether ``max_tokens`` is exceeded."""
    spark = docs.sparkSession
    tokens = frequent_pretokens(docs, text_col, sample_rows, table_words)
    # A pre-token of LONGEST characters has fewer than 256 tokens.
    lengths = bytes(len(e.ids) for e in Encoder(path, counts=True).library.encode_batch_fast(tokens, add_special_tokens=False))
    tier_one = spark.sparkContext.broadcast(("\n".join(tokens), lengths))
    key = ("counts", path, uuid.uuid4().hex)

    def run(batches):
        names, counted = tier_one.value
        encoder = Encoder.of_worker(key, path, counts=True, known=dict(zip(names.split("\n"), counted)))
        for b in batches:
            texts = b.column(1).to_pylist()
            counts = []
            for i, j in slices(texts):
                counts += encoder.encode(texts[i:j])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > max_tokens for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
