"""Operator 3: contiguous shards of nearly equal bytes, from global prefix sums. Native: no Python runs on executors.

Rows are ordered by (doc_id, size, text_crc32) and dealt to range partitions. Each partition's total is one row; a
prefix sum over those few rows gives every partition the bytes and rows before it, and a running sum inside the
partition gives every document its place in the whole order. A document goes to the shard in whose equal share of the
bytes it starts, so a shard's size is off its target by less than one document.

Nulls: a null text has no bytes (size 1, crc 0); null ids come first. Empty texts count 1 byte. Repeated rows are
separate rows with separate slots; which of two identical rows comes first can't be told apart. A key that holds many
rows is split over partitions because the range order goes on after the key, down to a row number. An empty table
gives no rows. Other columns, also ones named like the results, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored, table

ORDER = ["doc_id", "size", "text_crc32", "row_tag"]


def placed(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row_tag"),
    )
    n_parts = partitions(docs.sparkSession)
    rows = stored(rows.repartitionByRange(n_parts, *ORDER).withColumn("part", F.spark_partition_id()), "shard_rows")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # at most one row for each range partition, however many documents there are
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*ORDER)
    start = F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")
    share = F.expr(f"least({n_shards - 1}, start_byte * {n_shards} div all_bytes)").cast("int")
    assigned = (
        rows.join(F.broadcast(totals), "part")
        .withColumn("start_byte", start)
        .withColumn("nth", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", share)
    )
    firsts = assigned.groupBy("shard").agg(F.min("nth").alias("first"))  # n_shards rows
    return assigned.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot")
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _crc_table() -> str:
    """The 256 steps of CRC-32 (reversed polynomial), as a SQL list."""
    steps = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        steps.append(n)
    return "[" + ", ".join(map(str, steps)) + "]::bigint[]"


# Bytes come from the hex form; the CRC is a fold over them that starts with all ones.
OP3_SQL = f"""
with bytes as (select row_number() over () r, doc_id, octet_length(encode(coalesce(text, ''))) n, hex(encode(coalesce(text, ''))) h from documents),
codes as (select r, doc_id, n + 1 as size, list_concat([4294967295], list_transform(regexp_extract_all(h, '..'), lambda x: cast('0x' || x as bigint))) b from bytes),
crcs as (select r, doc_id, cast(size as bigint) size, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, list_extract({_crc_table()}, (xor(c, x) & 255) + 1)))) crc from codes),
placed as (select *, sum(size) over o - size before, sum(size) over () total from crcs window o as (order by doc_id nulls first, size, crc, r rows unbounded preceding)),
shards as (select *, cast(least(7, before * 8 // total) as int) shard from placed)
select doc_id, size, cast(crc as bigint) text_crc32, 'bytes' law, shard, row_number() over (partition by shard order by doc_id nulls first, size, crc, r) - 1 slot, cast(null as int) grown_shard from shards
"""
