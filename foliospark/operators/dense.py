"""Exact cosine search over embedding columns."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch_root, written

ROUND = 8_192
"""Distinct query vectors that the driver holds and sends at once, about."""
QUERY_BLOCK = 256
"""Query vectors that are multiplied with a batch at once."""
VECTOR_ROWS = 1_000
"""Vectors of a batch; a task holds ``QUERY_BLOCK * VECTOR_ROWS`` scores."""
NEAR = "kind long, v_id long, s double"


def unit(vector: Column) -> Column:
    """The vector over its length, in double precision; zero vectors stay zero."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as unit rows; all lists must have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def scores(questions: DataFrame, vectors: DataFrame, top: int | None, q_id: str = "q_id", v_id: str = "vec_id", q_vec: str = "q_vec", v_vec: str = "embedding", exclude_self: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """``(q_id, vec_id, dense_score)``: the exact ``top`` of each question, of ``allowed`` vectors only.

    Equal vectors are searched once.  They are dealt into rounds of about
    ``ROUND``: the driver holds and sends one round at a time, and its result is
    written, so neither its memory nor the plan grows with the questions.  A
    task multiplies blocks of them with each batch of vectors as matrices and
    keeps only its ``top`` by score and id.
    A filter applies before the search, so a rare document gets its hits.
    """
    spark = vectors.sparkSession
    asked = questions.select(F.col(q_id).cast("long").alias("q"), F.col(q_vec).cast("array<double>").alias("v")).filter("v is not null")
    kinds = written(asked.select("v").distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    rows = vectors.select(F.col(v_id).cast("long").alias("v_id"), F.col(v_vec).alias("v")).filter("v is not null")
    if allowed is not None:
        rows = rows.join(allowed.select(F.col(allowed.columns[0]).cast("long").alias("v_id")), "v_id", "left_semi")
    most = top + 1 if top and exclude_self else top  # one of them may be a question's own

    def search(sent):
        def run(batches):
            ids, every = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, VECTOR_ROWS):
                    b = batch.slice(at, VECTOR_ROWS)
                    own = b.column(0).to_numpy(zero_copy_only=False)
                    order = np.argsort(own, kind="stable")
                    own, matrix = own[order], _matrix(b.column(1))[order].T
                    for k in range(0, len(ids), QUERY_BLOCK):
                        s = np.round(every[k : k + QUERY_BLOCK] @ matrix, 6)
                        # Columns ascend by id, so a stable sort breaks ties by id.
                        best = np.argsort(-s, axis=1, kind="stable")[:, : min(most or len(own), len(own))]
                        s = np.take_along_axis(s, best, axis=1)
                        keep = np.isfinite(s)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[k : k + QUERY_BLOCK], keep.sum(axis=1))), pa.array(own[best[keep]]), pa.array(s[keep])], ["kind", "v_id", "s"])

        return rows.mapInArrow(run, NEAR)

    rounds = max(1, math.ceil(kinds.count() / ROUND))
    path = f"{scratch_root(spark).rstrip('/')}/near-{uuid.uuid4().hex}"
    for k in range(rounds):
        block = kinds.filter(F.pmod(F.xxhash64("kind"), F.lit(rounds)) == k).toArrow()
        if not block.num_rows:
            spark.createDataFrame([], NEAR).write.mode("append").parquet(path)
            continue
        sent = spark.sparkContext.broadcast((block["kind"].to_numpy(), _matrix(block["v"].combine_chunks())))
        search(sent).write.mode("append").option("compression", "zstd").parquet(path)
        sent.destroy()
    found = spark.read.schema(NEAR).parquet(path).hint("merge")  # as ``stored`` tables
    if most:
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("s"), "v_id"))).filter(F.col("rank") <= most)
    out = asked.join(kinds, "v").select("q", "kind").join(found.select("kind", "v_id", "s"), "kind")
    if exclude_self:
        out = out.filter("q <> v_id")
    return out.select(F.col("q").alias(q_id), F.col("v_id").alias(v_id), F.col("s").alias("dense_score"))


def top_k(scored: DataFrame, n: int, q_id: str = "q_id", v_id: str = "vec_id") -> DataFrame:
    order = Window.partitionBy(q_id).orderBy(F.desc("dense_score"), v_id)
    return scored.withColumn("dense_rank", F.row_number().over(order).cast("long")).filter(F.col("dense_rank") <= n)


def normalized(vectors: DataFrame, v_id: str = "vec_id", v_vec: str = "embedding") -> DataFrame:
    """The vector table of an index: ids and unit vectors in single precision; rows without a vector are an error later on."""
    return vectors.select(v_id, unit(F.col(v_vec)).cast("array<float>").alias(v_vec))


def threshold_search(scored: DataFrame, n: int, threshold: float, q_id: str = "q_id", v_id: str = "vec_id") -> DataFrame:
    """Ranks are given before the threshold, as a caller sees them."""
    return top_k(scored, n, q_id, v_id).filter(F.col("dense_score") >= threshold)


def lookup(pairs: DataFrame, questions: DataFrame, vectors: DataFrame, q_id: str = "q_id", v_id: str = "vec_id", q_vec: str = "q_vec", v_vec: str = "embedding") -> DataFrame:
    """Exact cosine of given pairs; 0.0 where a vector is missing."""
    q = questions.select(q_id, unit(F.col(q_vec)).alias("__q"))
    v = vectors.select(v_id, unit(F.col(v_vec)).alias("__v"))
    both = pairs.join(q, q_id, "left").join(v, v_id, "left")
    return both.withColumn("dense_score", F.round(F.coalesce(dot(F.col("__q"), F.col("__v")), F.lit(0.0)), 6)).drop("__q", "__v")
