"""Operator 11: documents packed into windows of tokens by patterns of lengths.

Each document is its ids and one end id; only one that is longer than a window is cut, into full windows and a rest.
A pattern is a way to fill a window with few pieces: one of the full length, or two or three whose lengths sum to it.
All patterns of lengths that occur are enumerated, and non-negative least squares fit how often to repeat each one, so
that together they use up the histogram of lengths; too few long pieces weigh more than too few short ones, as short
ones find room anywhere. The counts are rounded, as far as pieces are there, and what no pattern takes is packed best
fit decreasing.

Lengths alone decide, and there are at most `window` of them: the tasks count, and the driver sees at most `window`
numbers and fits at most window^2 / 12 patterns, whatever the corpus. The n-th piece of a length reads its sequence and
offset from the plan (some thousand rows, broadcast). Pieces are stored once with their ids and their rank among the
pieces of their length in their task; a prefix sum over the tasks makes it a rank overall. No group is gathered.

The fit is by an active set, as Lawson and Hanson's, but lets many columns in at once: patterns with the steepest
descent that share no length. The least squares over the active columns are solved by conjugate gradients (a pattern has
at most three lengths), and steps stop where a count would fall below zero. So a solution has about as many patterns
as there are lengths, and rounding keeps most of it.

Ties: pieces of equal length go by their task's number and their place in it; patterns that are equally good by their
order. Nulls: a null or empty text is one end id. Null and repeated doc_ids, and equal texts, are separate documents. An
empty table gives no rows. Other columns are not read. Very long texts give many full windows, each a pattern of one.
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
from .packing import plan as best_fit
from .word_ids import word_ids

WINDOW = 2048
END_ID = 0
#: Bytes of texts that a task encodes together.
TOGETHER = 8 << 20
#: Weight of a length's misfit in the least squares: LIGHT for the shortest, 1 from half of a window on.
LIGHT = 0.1
#: Columns that may enter the active set at once, and rounds at most; the part of the histogram's squares that may stay unmatched.
ENTER, ROUNDS, UNMATCHED = 256, 100, 1e-6
#: A mean square misfit of lengths (in pieces) that rounding would undo: closer is close enough.
ROUNDED = 0.05
#: Steps of conjugate gradients in a solution, and the part of the squared gradient at which they end.
STEPS, SETTLED = 50, 1e-6


def patterns(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, of lengths that occur, with a + b + c = window; 0 is no piece."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found = [np.array([[window, 0, 0]])] if there[window] else []
    firsts = np.flatnonzero(there)
    firsts = firsts[(3 * firsts >= window) & (firsts < window)]
    for a in firsts.tolist():
        b = np.arange(-(-(window - a) // 2), min(a, window - a) + 1)
        c = window - a - b
        b, c = (x[there[b] & (there[c] | (c == 0))] for x in (b, c))
        found.append(np.column_stack([np.full(len(b), a), b, c]))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def repeats(counts: np.ndarray, shapes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """counts[length], shapes (patterns) -> how often to repeat each, by weighted non-negative least squares."""
    weight = np.where(np.arange(window + 1) > 0, np.clip(np.arange(window + 1) * 2 / window, LIGHT, 1), 0.0)  # no piece: no misfit
    target, x = counts * weight, np.zeros(len(shapes))
    active = np.zeros(0, int)

    def of(columns: np.ndarray, y: np.ndarray) -> np.ndarray:
        return weight * np.bincount(shapes[columns].ravel(), np.repeat(y, 3), window + 1)

    def back(columns: np.ndarray, r: np.ndarray) -> np.ndarray:
        return (weight * r)[shapes[columns]].sum(axis=1)

    def solved(columns: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Least squares over the columns, from y, by conjugate gradients on the normal equations."""
        r = target - of(columns, y)
        s = back(columns, r)
        p, old = s, s @ s
        least = SETTLED * old
        for _ in range(STEPS):
            if old <= least:
                break
            q = of(columns, p)
            step = old / (q @ q)
            y, r = y + step * p, r - step * q
            s = back(columns, r)
            new = s @ s
            p, old = s + new / old * p, new
        return y

    every, whole = np.arange(len(shapes)), target @ target
    enough = max(UNMATCHED * whole, ROUNDED * ((weight * (counts > 0)) ** 2).sum())
    for _ in range(ROUNDS):
        r = target - of(active, x[active])
        if r @ r <= enough:
            break
        descent = back(every, r)
        descent[active] = 0
        steepest = np.argsort(-descent, kind="stable")[: 16 * ENTER]
        entering, used = [], np.zeros(window + 1, bool)
        for k in steepest[descent[steepest] > 1e-9 * whole**0.5].tolist():
            if not used[shapes[k][shapes[k] > 0]].any():
                used[shapes[k]] = True
                entering.append(k)
                if len(entering) == ENTER:
                    break
        if not entering:
            break
        active = np.concatenate([active, np.array(entering)])
        while len(active):
            y = solved(active, x[active])
            if (y > 0).all():
                x[active] = y
                break
            low = y <= 0
            held = x[active]
            step = np.min(held[low] / np.maximum(held[low] - y[low], 1e-300))
            moved = held + step * (y - held)
            stays = ~low | (moved > 1e-12 * max(held.max(), 1))  # what is at zero, and would go below, leaves
            x[active] = np.where(stays, moved, 0)
            active = active[stays]
    return x


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """counts: pieces by length -> rows (length, first rank, end rank, first sequence, pieces in each sequence, offset).

    Piece rank r of a row is in sequence first + j // each at offset + (j % each) * length, where j = r - first rank.
    """
    left = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    total = left.copy()
    shapes = patterns(np.flatnonzero(left), window)
    fitted = repeats(left.astype(float), shapes, window)
    wanted = np.floor(fitted + 0.5).astype(np.int64)
    rows, opened = [], 0
    for k in sorted(np.flatnonzero(wanted).tolist(), key=lambda k: (-fitted[k], k)):
        uses = Counter(int(v) for v in shapes[k] if v)
        n = int(min(wanted[k], *[left[v] // m for v, m in uses.items()]))
        if n:
            at = 0
            for v, m in uses.items():
                for _ in range(m):
                    rank = int(total[v] - left[v])
                    rows.append((v, rank, rank + n, opened, 1, at))
                    left[v] -= n
                    at += v
            opened += n
    done = total - left
    rest = {int(v): int(left[v]) for v in np.flatnonzero(left)}
    for length, lo, hi, first, each, at in best_fit(rest, window):
        base = int(done[length])
        rows.append((length, lo + base, hi + base, opened + first, each, at))
    return rows


def cut(docs: DataFrame, json_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Stored pieces: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), part, nth (of its length there)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length int, ids binary, part int, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(json_path).encode
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        end = np.array([end_id], "<u4")

        def pieces(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.concat_batches(held)
            of, out = [], []
            for k, ids in enumerate(encode([t or "" for t in whole.column("text").to_pylist()])):
                ids = np.concatenate([ids, end])
                for n, at in enumerate(range(0, len(ids), window)):
                    p = ids[at : at + window]
                    of.append(k)
                    out.append((n, at, len(p), p.tobytes(), seen[len(p)]))
                    seen[len(p)] += 1
            n, start, length, ids, nth = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [whole.column("doc_id").take(pa.array(of)), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(ids, pa.binary()), pa.array([part] * len(of), pa.int32()), pa.array(nth, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids", "part", "nth"],
            )

        held, size = [], 0
        for b in batches:
            if len(b):
                held.append(b)
                size += b.column("text").nbytes
            if size >= TOGETHER:
                yield pieces(held)
                held, size = [], 0
        if held:
            yield pieces(held)

    spark = docs.sparkSession
    path = new_path(spark, "pattern_pieces")
    arrow(rows, run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def packed(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    places = F.broadcast(spark.createDataFrame(plan(counts, window), "length int, lo long, hi long, first long, each int, at int"))
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


def op11_pattern_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = cut(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth")
    return packed(narrow).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
