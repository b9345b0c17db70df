"""Operator 12: hard negatives for a stated set of anchors, by a full sort of each anchor's scores.

A vector is made integer (floor of 256 times each component), so that scores are exact. For an anchor all rows are
scored, sorted by score (highest first) and id by a lexsort, its positives are the first rows of its label, and for each
positive the sorted scores are searched by bisection for the upper limit; from there on the first rows of another label
are read as long as they keep the lower limit.

Rows are stored once in blocks of at most ROWS rows (a matrix of integers, ids and labels); the anchors of a block make
blocks of at most QUERIES. A task holds one block of each; every block of anchors meets every block of rows, once for
the positives and once for the negatives. Each anchor's sorted order is that of all blocks, merged: a block gives at most
its first `positives` rows of the label, and at most its first `k` rows for a positive, and a window with a limit (which
Spark applies before the shuffle as well) keeps the first of all. Time is anchors times rows; memory depends on the
blocks' sizes alone.

Rows with a null label, a null vector, or a null or non-finite component take no part. Repeated rows are rows of their
own: an anchor's copy is another row, and a repeated anchor gives its rows twice. A null id is no anchor and comes after
all ids in ties; otherwise equal scores go by the smaller id, and rows with equal score and id are interchangeable in the
result. Vectors of different lengths are compared as if the shorter one went on with zeros; an empty vector scores 0.
Scores are exact as long as they fit into 64 bits, and else the nearest number that does. An empty table gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, stored, table

SCALE = 256
ROWS, QUERIES = 16_384, 256
POSITIVES, K = 5, 10
#: Hundredths of a positive's score that a negative's lies within.
LOWER, UPPER = 30, 90
#: Sums of products up to this are exact in doubles.
EXACT = 1 << 53
LAST = (1 << 63) - 1  # stands for a null id in the order

LEAST = -LAST - 1
#: Lanes that blocks of rows are dealt to, at most.
LANES = 10_000

BLOCK = "block long, n int, dim int, kind string, ids binary, no_id binary, labels binary, anchors binary, vectors binary"
ASKED = "q_block long, q_nth int, home long, places binary, q_dim int, q_kind string, q_ids binary, q_labels binary, q_vectors binary"


def usable(label: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))


def narrowest(matrix: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest of three types."""
    most = np.abs(matrix).max(initial=0)
    return matrix.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8")


def _rows(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))]))


def blocks(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """(id long, label long, vector array<double>, anchor boolean) -> stored BLOCKs of at most `most` rows each, as they lie in their tasks."""

    def packed(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        ids, vectors = whole["id"].combine_chunks(), whole["vector"].combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        matrix = np.zeros((len(sizes), int(sizes.max(initial=0))))
        matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = np.floor(SCALE * vectors.flatten().to_numpy())
        matrix = narrowest(matrix)
        bits = lambda x: np.packbits(x.to_numpy(zero_copy_only=False).astype(bool)).tobytes()
        row = {"block": block, "n": len(sizes), "dim": matrix.shape[1], "kind": matrix.dtype.str, "ids": ids.fill_null(LAST).to_numpy().tobytes(), "no_id": bits(ids.is_null())}
        return _rows(BLOCK, [row | {"labels": whole["label"].to_numpy().tobytes(), "anchors": bits(whole["anchor"].combine_chunks()), "vectors": matrix.tobytes()}])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            while len(b):
                take = b.slice(0, most - size)
                held.append(take)
                size, b = size + len(take), b.slice(len(take))
                if size == most:
                    yield packed(block, held)
                    held, size, block = [], 0, block + 1
        if held:
            yield packed(block, held)

    return stored(arrow(rows.select("id", "label", "vector", "anchor"), run, BLOCK), "vector_blocks")


class Block:
    def __init__(self, row: dict):
        self.number, self.ids, self.labels = row["block"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(row["n"], row["dim"])
        self.no_id, self.anchors = (np.unpackbits(np.frombuffer(row[c], np.uint8), count=row["n"]).astype(bool) for c in ("no_id", "anchors"))


class Asked:
    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_labels"], np.int64)
        self.vectors = np.frombuffer(row["q_vectors"], row["q_kind"]).reshape(len(self.ids), row["q_dim"])
        self.home, self.places = row["home"], np.frombuffer(row["places"], np.int32)


def anchors(whole: DataFrame, queries: int = QUERIES) -> DataFrame:
    """The anchors of each block, in stored ASKED blocks with their places at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row)
            at = np.flatnonzero(block.anchors & ~block.no_id)
            for nth, k in enumerate(range(0, len(at), queries)):
                j = at[k : k + queries]
                yield _rows(ASKED, [{"q_block": block.number, "q_nth": nth, "home": block.number, "places": j.astype(np.int32).tobytes(), "q_dim": row["dim"], "q_kind": row["kind"], "q_ids": block.ids[j].tobytes(), "q_labels": block.labels[j].tobytes(), "q_vectors": block.vectors[j].tobytes()}])

    return stored(arrow(whole, run, ASKED), "anchor_blocks")


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all of b: in doubles where those are exact, else in whole numbers of any size, cut to 64 bits."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim].astype(float), b[:, :dim].astype(float)
    if dim * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: [[int(v) for v in r] for r in m]
    of_b = whole(b)
    return np.array([[min(max(sum(map(int.__mul__, x, y)), LEAST), LAST) for y in of_b] for x in whole(a)], np.int64).reshape(len(a), len(b))


def sorted_scores(s: np.ndarray, block: Block) -> np.ndarray:
    """Rows by score, highest first, then by id, null ids last."""
    return np.lexsort((block.no_id, block.ids, ~s))  # ~s falls as s rises, without overflow


def met(whole: DataFrame, asked: DataFrame, find: Callable[[Block, Asked, dict], list[tuple]], schema: str) -> DataFrame:
    """find over every pair of a block of rows and one of anchors. Blocks of rows are dealt to lanes, and every block of anchors goes to every lane."""
    n, parts = whole.agg(F.count("*"), F.max(F.shiftright("block", 32))).first()
    lanes = max(1, min(n, LANES))
    dealt = whole.withColumn("lane", F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF) * ((parts or 0) + 1), F.lit(lanes)).cast("int"))
    sent = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    pairs = dealt.repartition(lanes, "lane").join(sent.repartition(lanes, "lane"), "lane")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row)
            ids = pa.array(block.ids, mask=block.no_id)
            found = find(block, Asked(row), row)  # (j, other columns) each
            if found:
                j = np.concatenate([np.atleast_1d(x[0]) for x in found])
                rest = [np.concatenate([np.broadcast_to(x[c], x[0].shape) for x in found]) for c in range(1, len(found[0]))]
                of = [np.full(len(j), row[c]) for c in ("q_block", "q_nth")]
                yield pa.RecordBatch.from_arrays([pa.array(of[0]), pa.array(of[1], pa.int32()), ids.take(pa.array(j)), *[pa.array(r.astype(np.int64)) for r in rest]], names=names)

    return arrow(pairs, run, schema)


def first(df: DataFrame, keys: list[str], n: int, out: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn(out, F.row_number().over(order)).where(F.col(out) <= n)


def mined(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding", positives: int = POSITIVES, k: int = K, lower: int = LOWER, upper: int = UPPER, most: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for the anchors among rows, each of their
    positives, and its first k rows of another label with lower * positive <= 100 * negative <= upper * positive."""
    label = F.col("label") if label is None else label
    used = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    whole = blocks(used.where(usable(F.col("label"), F.col("vector"))), most)
    asked = anchors(whole, queries)

    def same_label(block: Block, q: Asked, row: dict) -> list[tuple]:
        out = []
        for i, s in enumerate(scores(q.vectors, block.vectors)):
            order = sorted_scores(s, block)
            same = order[block.labels[order] == q.labels[i]]
            if q.home == block.number:
                same = same[same != q.places[i]]
            out.append((same[:positives], i, q.ids[i], s[same[:positives]]))
        return out

    kept = met(whole, asked, same_label, "q_block long, q_nth int, id long, q long, anchor_id long, score long")
    kept = stored(first(kept, ["q_block", "q_nth", "q"], positives, "nth"), "positives")
    wanted = kept.groupBy("q_block", "q_nth").agg(F.collect_list(F.struct("q", "nth", "score")).alias("wanted"))  # at most `queries` times `positives`

    def other_label(block: Block, q: Asked, row: dict) -> list[tuple]:
        out, by = [], defaultdict(list)
        for w in row["wanted"]:
            by[w["q"]].append((w["nth"], w["score"]))
        each = list(by)
        for i, s in zip(each, scores(q.vectors[each], block.vectors), strict=True):
            order = sorted_scores(s, block)
            falling = ~s[order]  # rises
            others = np.flatnonzero(block.labels[order] != q.labels[i])
            for nth, positive in by[i]:
                high, low = (min(max(v, LEAST), LAST) for v in (upper * positive // 100, -(-lower * positive // 100)))
                begin, end = np.searchsorted(falling, ~high, "left"), np.searchsorted(falling, ~low, "right")
                at = others[np.searchsorted(others, begin) :][:k]
                j = order[at[at < end]]
                out.append((j, i, nth, s[j]))
        return out

    found = met(whole, asked.join(wanted, ["q_block", "q_nth"]), other_label, "q_block long, q_nth int, id long, q long, nth long, score long")
    keys = ["q_block", "q_nth", "q", "nth"]
    negatives = first(found, keys, k, "rank").select(*keys, "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = kept.select("q_block", "q_nth", "q", F.col("nth").cast("long").alias("nth"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, keys).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7, the label is moved by one; anchors are the rows whose vec_id is divisible by 100."""
    n = F.col("vec_id")
    label = F.when(F.coalesce(n % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), n % 100 == 0, label=label)


OP12_SQL = """
with used as (select row_number() over () r, vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (select a.r ar, a.vec_id anchor_id, b.r br, b.vec_id id, a.label = b.label same, cast(list_dot_product(a.v, b.v) as bigint) score from used a join used b on a.vec_id % 100 = 0),
positives as (select ar, br, anchor_id, id positive_id, score positive_score from scored where same and ar <> br qualify row_number() over (partition by ar order by score desc, id nulls last) <= 5),
ranked as (select anchor_id, positive_id, row_number() over (partition by p.ar, p.br order by score desc, id nulls last) n, id negative_id, positive_score, score negative_score
  from positives p join scored s using (ar, anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(n as int) as rank, negative_id, positive_score, negative_score from ranked where n <= 10
"""
