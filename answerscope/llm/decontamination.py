"""Operator 9: benchmark passages in training texts, by suffix arrays of the training shards.

A training shard is a run of documents of about SHARD_WORDS words. Its suffix array orders every suffix that could match
at all (it stands in enough consecutive words that the benchmark knows) by as many words as the longest item has; ranks
of 10, 20, 40, ... words come from prefix doubling over the shard and the test texts together. Every test suffix is
binary-searched in the array, which gives the range of places where its window occurs; the ranks then tell how far each
place goes on like the test suffix. So every longest verbatim match is known with its place in the document and in the
item. Shards are independent tasks, no rows are shuffled, and whole texts are read.

The benchmark is collected and sent in blocks of about BLOCK_BYTES of text, of which a task holds one at a time: every
shard is searched for one block after the other, and no text is read or written again. Pairs of a test suffix and a
place with its window are made PAIRS at a time and kept as the longest match of each item and document only. Measured at
the worst (a block whose items are whole documents of up to 20,000 words, and a shard that is made of them): 197 MB.

Nulls: a null or word-less document has n_words 0, no hits; items without words match nothing; an item with a null id
marks words but is not listed. Repeated items count once by id, repeated documents each get their row. Of equally long
matches of an item in a document, the first in the document counts, then the first in the item. Empty tables give no
rows, or no hits. Columns besides those named are only carried by clean().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow, table

WINDOW = 10
SHARD_WORDS = 500_000
BLOCK_BYTES = 4 << 20
PAIRS = 1 << 20
#: Lower-cases A-Z and makes a separator of every ASCII byte that is no letter or digit.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

MATCH = [("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]
MATCHES = "array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"
SPAN = [("a", pa.int64()), ("b", pa.int64())]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Tests:
    """The test suffixes of one block of items: one row of word ids, 0 after each item, and where the suffixes are in it."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.window, self.vocabulary, self.names = window, {}, []
        number: dict[str | None, int] = {}
        rows, starts, of, offsets, sizes, at = [], [], [], [], [], 0
        for name, text in dict.fromkeys(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            if name not in number:
                number[name] = len(self.names)
                self.names.append(name)
            size = min(window, len(ids))
            n = len(ids) - size + 1
            rows.append(np.array([*ids, 0], np.int32))
            starts.append(np.arange(at, at + n, dtype=np.int32))
            of.append(np.full(n, number[name], np.int32))
            offsets.append(np.arange(n, dtype=np.int32))
            sizes.append(np.full(n, size, np.int32))
            at += len(ids) + 1
        joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.text, self.starts, self.of, self.offsets, self.sizes = map(joined, (rows, starts, of, offsets, sizes))
        self.longest = max((len(r) - 1 for r in rows), default=0)
        self.shortest = int(self.sizes.min()) if len(self.sizes) else 0
        self.bits = max(1, len(self.vocabulary).bit_length())

    def keys(self, text: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
        """The first `window` ids of the places' suffixes, packed into as few integers as hold them, first words first."""
        out, per_key = [], 62 // self.bits
        for at in range(0, self.window, per_key):
            key = np.zeros(len(places), np.int64)
            for c in range(at, min(at + per_key, self.window)):
                key = key << self.bits | text[np.minimum(places + c, len(text) - 1)]
            out.append(key)
        return out


class Shard:
    """A suffix array over the words of some documents, ranked together with the test texts."""

    def __init__(self, docs: list[list[bytes]], tests: Tests):
        self.sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.first_test = int(self.sizes.sum()) + len(docs)
        # one separator (0, as are unknown words) after each document, and a last one at the end
        x = np.zeros(self.first_test + len(tests.text) + 1, np.int32)
        get = tests.vocabulary.get
        for at, d in zip(self.starts.tolist(), docs, strict=True):
            x[at : at + len(d)] = np.fromiter((get(w, 0) for w in d), np.int32, len(d))
        x[self.first_test : -1] = tests.text
        places = np.arange(len(x), dtype=np.int32)
        zeros = np.where(x == 0, places, len(x)).astype(np.int32)
        end = np.minimum.accumulate(zeros[::-1])[::-1]
        begin = np.maximum.accumulate(np.where(x == 0, places + 1, 0).astype(np.int32))
        self.x, self.run = x, end - places  # known words from each place on
        # whole stretches of known words that are long enough to hold a window
        active = np.flatnonzero((x > 0) & (end - begin >= tests.shortest)).astype(np.int32)
        self.levels: list[tuple[int, np.ndarray]] = []
        self.order = np.zeros(0, np.int32)
        if not (active < self.first_test).any():
            return
        keys = tests.keys(x, active)
        order = np.lexsort(keys[::-1])
        fresh = np.zeros(len(active), bool)
        for k in keys:
            fresh[1:] |= np.diff(k[order]) != 0
        rank = np.empty(len(active), np.int32)
        rank[order] = np.cumsum(fresh) + 1
        height = tests.window
        while True:
            whole = np.zeros(len(x), np.int32)
            whole[active] = rank
            self.levels.append((height, whole))
            if height >= tests.longest or rank.max() == len(rank):
                break
            pair = rank.astype(np.int64) << 32 | whole[np.minimum(active + height, len(x) - 1)]
            rank = (np.unique(pair, return_inverse=True)[1] + 1).astype(np.int32)
            height *= 2
        own = active[(active < self.first_test) & (self.run[active] >= tests.shortest)]
        self.order = own[np.argsort(self.levels[-1][1][own], kind="stable")]

    def ranges(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """By binary search: where in the suffix array the places with each test suffix's window begin and end."""
        at = tests.starts + self.first_test
        rank, sought = self.levels[0][1][self.order], self.levels[0][1][at]
        lo, hi = np.searchsorted(rank, sought), np.searchsorted(rank, sought, "right")
        short = np.flatnonzero(tests.sizes < tests.window)  # shorter windows are only the first words of a key
        if len(short):
            keys = tests.keys(self.x, self.order)
            for bound, fill in ((lo, 0), (hi, (1 << tests.bits) - 1)):
                text = np.full((len(short), tests.window), fill, np.int32)
                for k, j in enumerate(short):
                    text[k, : tests.sizes[j]] = self.x[at[j] : at[j] + tests.sizes[j]]
                bound[short] = _before(keys, tests.keys(text.ravel(), np.arange(len(short)) * tests.window), fill > 0)
        return lo, hi

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal known words from two places on, by the ranks and then word by word."""
        end = len(self.x) - 1
        same = np.zeros(len(a), np.int32)
        for height, rank in reversed(self.levels):
            same += height * (rank[np.minimum(a + same, end)] == rank[np.minimum(b + same, end)])
        for _ in range(self.levels[0][0] - 1):
            u, v = self.x[np.minimum(a + same, end)], self.x[np.minimum(b + same, end)]
            same += (u == v) & (u > 0)
        return np.minimum(same, np.minimum(self.run[a], self.run[b]))


def _before(keys: list[np.ndarray], sought: list[np.ndarray], also_equal: bool) -> np.ndarray:
    """By binary search: how many of the sorted keys are less than (or equal to) each sought one."""
    lo, hi = np.zeros(len(sought[0]), np.int64), np.full(len(sought[0]), len(keys[0]), np.int64)
    while (lo < hi).any():
        mid = np.minimum((lo + hi) // 2, len(keys[0]) - 1)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, s in zip(keys, sought, strict=True):
            at = k[mid]
            less |= same & (at < s)
            same &= at == s
        if also_equal:
            less |= same
        go = lo < hi
        lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
    return lo


def _longest(found: np.ndarray) -> np.ndarray:
    """Of rows (document, item, words, place, offset): for each document and item the longest, then the first."""
    found = found[np.lexsort((found[:, 4], found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[first]


def search(docs: list[list[bytes]], tests: Tests, pairs: int = PAIRS) -> tuple[list[np.ndarray], list[list[dict]]]:
    """(which words are covered, the longest match of each item) for each document."""
    edge = np.zeros(0, np.int32)
    best = np.zeros((0, 5), np.int64)
    shard = Shard(docs, tests)
    if len(shard.order):
        lo, hi = shard.ranges(tests)
        edge = np.zeros(shard.first_test + 1, np.int32)
        hit = np.flatnonzero(hi > lo)
        ends = np.cumsum((hi - lo)[hit])
        total, at = int(ends[-1]) if len(ends) else 0, 0
        while at < total:  # pairs of a test suffix and a place with its window
            nth = np.arange(at, min(at + pairs, total))
            at += len(nth)
            j = np.searchsorted(ends, nth, "right")
            k = hit[j]
            place = shard.order[lo[k] + nth - (ends[j] - (hi - lo)[k])]
            test = tests.starts[k] + shard.first_test
            # a match that also goes on to the left is part of a longer one
            whole = ~((tests.offsets[k] > 0) & (shard.x[place - 1] == shard.x[test - 1]) & (place > 0))
            place, test, k = place[whole], test[whole], k[whole]
            size = shard.common(place, test)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + size, -1)
            doc = np.searchsorted(shard.starts, place, "right") - 1
            best = _longest(np.concatenate([best, np.stack([doc, tests.of[k], size, place - shard.starts[doc], tests.offsets[k]], axis=1)]))
        edge = np.cumsum(edge)
    covered = [edge[a : a + n] > 0 if len(edge) else np.zeros(n, bool) for a, n in zip(shard.starts.tolist(), shard.sizes.tolist(), strict=True)]
    matches: list[list[dict]] = [[] for _ in docs]
    for doc, item, size, place, offset in best.tolist():
        if tests.names[item] is not None:
            matches[doc].append({"item_id": tests.names[item], "doc_word": place, "item_word": offset, "n_words": size})
    return covered, matches


def _in_blocks(docs: list[list[bytes]], sent: list[Broadcast]) -> tuple[list[np.ndarray], list[list[dict]]]:
    covered, matches = [np.zeros(len(d), bool) for d in docs], [[] for _ in docs]
    for block in sent:
        more, found = search(docs, block.value)
        if len(sent) > 1:
            vars(block).pop("_value", None)  # a task holds one block; the next use reads the executor's copy again
        covered = [a | b for a, b in zip(covered, more, strict=True)]
        matches = [a + b for a, b in zip(matches, found, strict=True)]
    return covered, [sorted(m, key=lambda x: x["item_id"]) for m in matches]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """key (docs' id_col), n_words, n_hit, spans (covered words) and matches (the longest for each item) of every row."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    sent = []
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k)
        sent.append(docs.sparkSession.sparkContext.broadcast(Tests([(r["id"], bytes(r["text"]) if r["text"] is not None else None) for r in block.collect()])))
    df = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    names = ["key", *(["text"] if keep_text else [])]
    schema = StructType(df.select(*names).schema.fields + StructType.fromDDL(f"n_words long, n_hit long, spans array<struct<a:bigint,b:bigint>>, matches {MATCHES}").fields)

    def told(held: list[tuple[pa.RecordBatch, list[list[bytes]]]]) -> Iterator[pa.RecordBatch]:
        covered, matches = _in_blocks([d for _, words in held for d in words], sent)
        at = 0
        for b, words in held:
            own, found = covered[at : at + len(b)], matches[at : at + len(b)]
            at += len(b)
            cuts = [np.flatnonzero(np.diff(np.r_[False, c, False].astype(np.int8))).tolist() for c in own]
            spans = [[{"a": a, "b": z} for a, z in zip(c[::2], c[1::2], strict=True)] for c in cuts]
            columns = [pa.array([len(w) for w in words], pa.int64()), pa.array([int(c.sum()) for c in own], pa.int64()), pa.array(spans, pa.list_(pa.struct(SPAN))), pa.array(found, pa.list_(pa.struct(MATCH)))]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *columns], names=[*names, "n_words", "n_hit", "spans", "matches"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            words = [words_of(t.as_py()) for t in b.column("text")]
            held.append((b, words))
            n += sum(map(len, words))
            if n >= SHARD_WORDS:
                yield from told(held)
                held, n = [], 0
        if held:
            yield from told(held)

    return arrow(df, run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark window."""
    key = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    marked = contamination(docs.select(key.alias("row"), F.col(text_col).alias("text")), benchmark, "row", "text", keep_text=True)
    return marked.where("n_hit = 0").select(*[F.col("text").cast("string").alias(c) if c == text_col else F.col("key")[c].alias(c) for c in docs.columns])


def op9_benchmark_suffixes(spark, sf_dir: str) -> DataFrame:
    items = F.transform("matches", lambda m: m["item_id"])
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        F.col("key").alias("doc_id"), "n_words", "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).alias("longest_match"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["item_id"], m["doc_word"], m["item_word"], m["n_words"])), ",").alias("locations"),
    )


#: Strings sort by code point in both engines.
OP9_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
bw as (select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bi as (select item_id, w, least(10, len(w)) k from bw where len(w) > 0),
win as (select item_id, a, k, array_to_string(w[a : a + k - 1], ' ') s from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) a from bi)),
ks as (select distinct k from win),
dwin as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') s from (select doc_id, w, ks.k k, unnest(range(1, len(w) - ks.k + 2)) i from dw, ks where len(w) >= ks.k)),
hit as (select d.doc_id, d.i, d.k, win.item_id, win.a from dwin d join win on d.k = win.k and d.s = win.s),
cov as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, i, k from hit)) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) l from (select distinct doc_id, item_id from hit) group by doc_id),
runs as (select doc_id, item_id, i - a d, k, i, a, i - row_number() over (partition by doc_id, item_id, i - a order by i) g from hit),
whole as (select doc_id, item_id, min(i) - 1 doc_word, min(a) - 1 item_word, count(*) + max(k) - 1 n from runs group by doc_id, item_id, d, g),
best as (select *, row_number() over (partition by doc_id, item_id order by n desc, doc_word, item_word) nth from whole),
longest as (select doc_id, max(n) n, string_agg(concat_ws(':', item_id, doc_word, item_word, n), ',' order by item_id) locations from best where nth = 1 group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, cast(coalesce(n, 0) as bigint) longest_match, coalesce(locations, '') locations
from dw left join cov using (doc_id) left join its using (doc_id) left join longest using (doc_id)
"""
