"""Operator 8: SimHash near-duplicates, linked through BK-trees.

A text's fingerprint takes the majority of each bit over the XXH64 hashes of its 3-word shingles. Equal fingerprints
are collapsed first, so exact copies never meet. Fingerprints within RADIUS bits link; a component is everything that
links reach.

Trees. A BK-tree hangs each child under its parent by their Hamming distance and a search follows only edges within the
radius. One tree over all fingerprints can't be broadcast (it grows with the data), and a search in it visits more nodes
the larger it is (395 of 10,000 and 1,764 of 100,000 measured; the README has what broadcast trees would take), so
the forest is sharded by an exact rule: 64 bits are cut into B blocks, two fingerprints within 3 bits agree on B-3 of
them at least, and each choice of B-3 blocks with their value names a shard. Trees and searches of a shard meet in the
task that holds it; no link is lost, and every link of a shard is found by its own tree. B grows with the number of
distinct fingerprints so that an average shard stays small. Shards over HEAVY are split again by the same rule on their
remaining bits. A shard sends on only a spanning forest of its links.

A subtree whose members already are in the searcher's component can't change anything and is skipped, so a large group
of near copies costs about one visit each.

Nulls: a null text, an empty one and one without words have fingerprint zero and link like any other; a null doc_id
takes part but is never the smallest unless a component has no other (component_id null). Repeated rows get the same
results. An empty table gives no rows. Other columns are not read. Long texts are hashed in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, marked, partitions, stored, table
from .components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints that an average shard may hold before one more block is used.
LIGHT = 64
#: Distinct fingerprints above which a shard is split again.
HEAVY = 20_000
CHUNK = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    words = (text or b"").lower().split()  # bytes: A-Z only; splits at space, \x09-\x0D
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]).tolist()
        starts = [0, *ends]
        if len(part) <= width:
            hashes = [digest(joined, SEED)]
        else:
            hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def tree_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct values: each value with the first one of its group."""
    n = len(values)
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    children: list[dict[int, int]] = [{}]
    pure = [True]  # whether a node's subtree is all of one component
    for i in range(1, n):
        q, mine, stack = values[i], i, [0]
        while stack:
            u = stack.pop()
            if pure[u] and root(u) == mine:
                continue
            d = (values[u] ^ q).bit_count()
            if d <= radius and (r := root(u)) != mine:
                up[max(r, mine)] = mine = min(r, mine)
            for far, c in children[u].items():
                if d - radius <= far <= d + radius:
                    stack.append(c)
        u = 0
        while True:
            if pure[u] and root(u) != mine:
                pure[u] = False
            d = (values[u] ^ q).bit_count()
            if d not in children[u]:
                children[u][d] = i
                break
            u = children[u][d]
        children.append({})
        pure.append(True)
        if i >= 32 and i & (i - 1) == 0:  # links made since may have made subtrees pure
            for u in range(i, -1, -1):
                pure[u] = all(pure[c] and root(c) == root(u) for c in children[u].values())
    return [(values[i], values[r]) for i in range(n) if (r := root(i)) != i]


def masks(blocks: int, bits: list[int], radius: int = RADIUS) -> list[int]:
    """For each choice of blocks - radius of the blocks that bits are cut into, the mask of their bits."""
    cut = [bits[len(bits) * k // blocks : len(bits) * (k + 1) // blocks] for k in range(blocks)]
    return [sum(1 << b for part in chosen for b in part) for chosen in combinations(cut, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_count(n: int, light: int = LIGHT) -> int:
    return next((b for b in range(RADIUS + 1, RADIUS + 5) if n <= light << (64 * (b - RADIUS) // b)), RADIUS + 5)


def links(classes: DataFrame, n: int, heavy: int = HEAVY) -> DataFrame:
    """classes: distinct fp (n of them) -> edges (a, b) that connect what the links connect."""
    spark = classes.sparkSession
    chosen = masks(block_count(n), list(range(64)))

    def keyed(df: DataFrame, options: dict[int, list[int]]) -> DataFrame:
        """A row for each shard of a fingerprint; options: the masks by the mask held so far."""
        exploded = None
        for held, ms in options.items():
            keys = F.explode(F.array(*[F.struct(F.lit(signed(held | m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(held | m))).alias("key")) for m in ms]))
            part = (df if held == 0 else df.where(F.col("mask") == F.lit(signed(held)))).select("fp", keys.alias("s")).select("fp", "s.mask", "s.key")
            exploded = part if exploded is None else exploded.unionByName(part)
        return exploded

    shards = keyed(classes, {0: chosen})
    big = stored(shards.groupBy("mask", "key").count().where(F.col("count") > heavy).drop("count"), "heavy")
    if big.head(1):
        again = {}
        for held in chosen:
            left = [b for b in range(64) if not held >> b & 1]
            again[held] = masks(RADIUS + 1, left)
        split = keyed(shards.join(big, ["mask", "key"], "left_semi"), again)
        shards = shards.join(big, ["mask", "key"], "left_anti").unionByName(split)
    shards = shards.repartition(partitions(spark), "mask", "key").sortWithinPartitions("mask", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 3), np.int64)

        def close(rows: np.ndarray) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(rows)]
            values = rows[:, 2].view(np.uint64)
            for k in np.flatnonzero(ends - starts > 1):
                out += tree_links(values[starts[k] : ends[k]].tolist())
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for b in batches:
            rows = np.concatenate([rest, np.stack([b.column(c).to_numpy() for c in ("mask", "key", "fp")], axis=1)])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            whole = last[-1] + 1 if len(last) else 0  # the last shard may go on in the next batch
            if whole:
                yield close(rows[:whole])
            rest = rows[whole:]
        if len(rest):
            yield close(rest)

    return arrow(shards.select("mask", "key", "fp"), run, "a long, b long").distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id for every row of docs."""
    fps = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    reached = components(links(classes.select("fp"), classes.count()))
    joined = reached.join(classes, reached["node"] == classes["fp"]).select("fp", "root", "least")
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(joined.join(roots, "root").select("fp", "component_id"), "linked")
    named = classes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # stored, so that both sides of the join are plain exchanges and a fingerprint of very many documents can be split
    return fps.join(stored(named, "component_of"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each component: the one with the smallest id, then the smallest text hash.

    What stays is decided on narrow keys. Rows whose key surely is that of a single row that stays are kept where they
    stand; only the others (copies, repeated rows, and the few that a bitmap takes for such) are shuffled.
    """
    # a key that is never null as a whole; its fields are nullable, as they are when read back
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"))
    rows = docs.withColumn("__key", key.cast(f"struct<id:{docs.schema[id_col].dataType.simpleString()},tag:bigint>"))
    named = stored(grouped(rows.select("__key", F.col(text_col).alias("text")), "__key", "text").select(F.col("doc_id").alias("key"), "component_id"), "named")
    first = named.groupBy("component_id").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("stays"))
    each = named.groupBy("key").agg((F.count("*") > 1).alias("several")).join(first, "key", "left")
    apart = stored(each.where(F.col("several") | F.col("stays").isNull()).select("key", "stays"), "apart")
    told = marked(rows, F.col("__key"), apart.select("key"), "__apart")
    alone = told.where(~F.col("__apart"))
    gone = apart.where(F.col("stays").isNull()).select(F.col("key").alias("__key"))
    others = told.where("__apart").dropDuplicates(["__key"]).join(gone, "__key", "left_anti")
    return alone.unionByName(others).drop("__key", "__apart")


def op8_simhash_bk(spark, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
