"""Written tables: scratch storage that all executors share, and tables that are built once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BUILT: dict[tuple[str, str, str], object] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; one of our own only in local mode, where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and later jobs do not run the plan above again.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``written``, for a table that grows with the questions or documents: its joins shuffle.

    Files are far smaller than their rows (2 MB for 2.8 million ranked ids), so by
    their size alone Spark would collect such a table on the driver to broadcast it.
    """
    return written(df, label).hint("merge")


def once(spark: SparkSession, source: str, label: str, build: Callable[[], object]):
    """What ``build`` gives for ``source``, built once an application; its tables must be ``written``."""
    key = (spark.sparkContext.applicationId, source, label)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]
