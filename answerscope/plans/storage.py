"""Intermediate results in the folder that the cluster names in spark.checkpoint.dir.

They are Parquet tables: every executor reads them, they cut the lineage, and they outlive the executor that wrote them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, a local master gets a folder of this machine; on a cluster that is an error,
    since each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="answerscope-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: What this process has put into the shared folder.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Removes the intermediate tables that this process has made so far: call it when no frame that reads them is needed any more."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back, so that they are computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
