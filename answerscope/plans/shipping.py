"""This package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch that goes to a Python worker (one row at least), where the session has left Spark's own bound.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, SPARKS = 2 << 20, 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """A worker holds a few MB of texts, however long its partition is."""
    if spark.conf.get(BATCH) in (str(SPARKS), f"{SPARKS}b"):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Executors import this package; where neither PYTHONPATH nor the working folder has it, Spark sends it to them, and batches of bounded bytes."""
    bound_batches(spark)
    package = Path(__file__).resolve().parents[1]
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(package.parent) in map(os.path.realpath, filter(None, places)):
        return
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # the driver serves it from here
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
