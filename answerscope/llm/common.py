"""What the operators share: table access, shipping this package, bounded Arrow batches, stored intermediate results, and telling rows apart by their keys without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import bound_batches, ship
from ..plans.storage import new_path, shared_dir, stored

__all__ = ["arrow", "marked", "new_path", "partitions", "shared_dir", "ship", "stored", "table"]

#: Rows that the Parquet reader decodes at once, where the session has left Spark's own number: its buffers hold so many whole texts.
READ = "spark.sql.parquet.columnarReaderBatchSize"
READ_ROWS, SPARKS_ROWS = 512, 4096
#: Bits of the map of marked keys: BITS_A_KEY for each, MOST_BITS (16 MB) in all.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 15, 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    if spark.conf.get(READ) == str(SPARKS_ROWS):
        spark.conf.set(READ, str(READ_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow in batches of bounded bytes: a worker holds a few MB of texts, however long its partition is."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def marked(df: DataFrame, key: Column, keys: DataFrame, out: str) -> DataFrame:
    """df with a boolean column that is true wherever key is among keys (of one column), and rarely elsewhere.

    A bitmap of the keys' hashes, built by partial aggregation, is broadcast in rows of 32,768 bits: at most MOST_BITS
    in all, however many keys there are. Rows that it leaves unmarked can be told apart where they stand; the marked
    ones, wrongly marked ones among them, are left to an exact join. So only few rows are shuffled while the keys
    number less than MOST_BITS / 10 or so, and no result depends on the bitmap's size.
    """
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * n).bit_length()))
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(bits).cast("long"))
    of_keys = keys.select(hashed(F.col(keys.columns[0])).alias("h"))
    maps = of_keys.groupBy(F.bitmap_bucket_number("h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__map"))
    rows = df.withColumn("__h", hashed(key)).withColumn("__nth", F.bitmap_bucket_number("__h")).withColumn("__at", F.bitmap_bit_position("__h"))
    joined = rows.join(F.broadcast(maps), F.col("__nth") == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.substring(F.col("__map"), (F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("__at % 8").cast("int")
    hit = F.coalesce(F.call_function("getbit", byte.cast("long"), bit) == 1, F.lit(False))
    return joined.withColumn(out, hit).drop("__h", "__nth", "__at", "__bucket", "__map")
