"""Makes the package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once an application; the driver keeps its own copy."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or not os.path.isdir(_HERE):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="foliospark-"), "foliospark.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(_HERE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(_HERE)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
