"""Operator 10: documents packed into windows of tokens by best-fit decreasing.

Each document is its ids and one end id. It is cut into full windows and a rest, and the pieces are placed longest
first, each into the open window with the least room that still holds it; a segment tree over remaining room finds it.

Only lengths matter to the placement, and there are at most `window` of them. So the tasks count pieces by length, and
the driver places whole runs of equal pieces at once: windows of equal history form a group, and one step fills as many
of a group's windows as the run reaches. That is the same placement as one piece at a time, over all documents
together, from a table of at most `window` rows, in a plan of some thousand rows. The n-th piece of a length reads its
sequence and offset from the plan.

The pieces (with their ids) are stored once in the shared folder, with their rank among the pieces of their length in
their task; a prefix sum over the tasks makes it a rank overall. No group is gathered anywhere.

Ties: pieces of equal length go by their task's number and their place in it; of windows with equal room, the group that
came to have it last is filled first, from its first window on.

Nulls: a null or empty text is one end id. Null and repeated doc_ids, and equal texts, are separate documents. An empty
table gives no rows. Other columns are not read. Very long texts give many full windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, new_path, table
from .tokens import encoder

WINDOW = 1024
END_ID = 0
#: Pieces in a batch that a task sends on.
SENT = 2048


class Tightest:
    """A segment tree over remaining room 0..most: the groups of open windows with that room."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _mark(self, room: int) -> None:
        i = self.leaves + room
        self.any[i] = bool(self.groups[room])
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def add(self, room: int, first: int, n: int) -> None:
        if n:
            self.groups[room].append((first, n))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        group = self.groups[room].pop()
        self._mark(room)
        return group

    def at_least(self, room: int) -> int | None:
        """The least room >= room that any open window has."""
        i = self.leaves + room
        if self.any[i]:
            return room
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """counts: pieces by length -> rows (length, first rank, end rank, first sequence, pieces in each sequence, offset).

    Piece rank r of a row is in sequence first + j // each at offset + (j % each) * length, where j = r - first rank.
    """
    tree, rows, opened = Tightest(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.at_least(length)
            if room is None:
                room, first, n = window, opened, -(-left // (window // length))
                opened += n
            else:
                first, n = tree.take(room)
            each = room // length  # a window that has just taken one is the tightest while it holds another
            put = min(left, n * each)
            rows.append((length, rank, rank + put, first, each, window - room))
            full, rest = divmod(put, each)
            tree.add(room - each * length, first, full)
            if rest:
                tree.add(room - rest * length, first + full, 1)
            used = full + bool(rest)
            tree.add(room, first + used, n - used)
            rank, left = rank + put, left - put
    return rows


def cut(docs: DataFrame, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Stored pieces: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), part, nth (of its length there)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length int, doc_tokens long, ids binary, part int, nth long"
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path).encode
        part, seen = TaskContext.get().partitionId(), Counter()

        def batch(b: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
            start, length, total, ids, nth = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(of)), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(total, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(of), pa.int32()), pa.array(nth, pa.int64())],
                names=names,
            )

        for b in batches:
            texts, of, out = b.column("text"), [], []
            for k in range(len(b)):
                ids = np.append(encode(texts[k].as_py() or ""), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    out.append((at, len(piece), len(ids), piece.tobytes(), seen[len(piece)]))
                    seen[len(piece)] += 1
                    of.append(k)
                    if len(of) >= SENT:
                        yield batch(b, of, out)
                        of, out = [], []
            if of:
                yield batch(b, of, out)

    spark = docs.sparkSession
    path = new_path(spark, "pieces")
    arrow(rows, run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def packed(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    schema = "length int, lo long, hi long, first long, each int, at int"
    places = F.broadcast(spark.createDataFrame(plan(counts, window), schema))
    prior = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    fits = (ranked["length"] == places["length"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"])
    j = F.col("rank") - F.col("lo")
    return ranked.join(places, fits).select(
        *[ranked[c] for c in pieces.columns if c not in ("part", "nth")],
        (F.col("first") + F.expr("(rank - lo) div each")).alias("sequence_id"),
        (F.col("at") + (j % F.col("each")) * ranked["length"]).cast("long").alias("offset"),
    )


def sequences(placed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """sequence_id and its `window` ids, pieces in place and the rest padded; a sequence has at most `window` pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pieces in (x.as_py() for x in b.column("pieces")):
                ids = np.full(window, pad_id, "<u4")
                for p in pieces:
                    ids[p["offset"] : p["offset"] + p["length"]] = np.frombuffer(p["ids"], "<u4")
                out.append(ids)
            values = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * window, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), lists], names=["sequence_id", "ids"])

    grouped = placed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "length", "ids")).alias("pieces"))
    return arrow(grouped, run, "sequence_id long, ids array<int>")


def pack(docs: DataFrame) -> DataFrame:
    """The contract's columns for docs with doc_id and text."""
    import public_tokenizers

    pieces = cut(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    narrow = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "part", "nth")
    return packed(narrow).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
