"""Operator 13: spelling variants, by merging subtrees of a trie with one character skipped or replaced.

Words are counted, and those that are long and frequent enough form a trie. At every node that branches, the child with
most words is heavy and the others (and a word that ends there) are light; a word is light at no more than log2(words)
nodes of its path. Two words that are one edit apart first differ at one node, where at least one of them is light. So
only light words look for partners, small subtrees in large ones:

- with their first character below the node skipped, among all words below the node,
- with it replaced by the heavy character, or with the heavy character put before it, below the heavy child,
- with it replaced by a wildcard, among the node's other light words.

Where terminals coincide, the words are one edit apart. A skip looks only where the next character is another one, so
that every pair is found once, at the node where its words part.

In Spark: words below a node with more than SHARD words are dealt to its children, level by level; such a node's heavy
child comes from counts, and the parts of a level that all words share are passed over at once. What is left are shards of at most SHARD
words, each a subtree in one task, whose merges look into the task's own words. For the few nodes above the shards, light words
carry their depth and the heavy character along, and look among all words by joins; light words that meet at a wildcard
are at most as many as the alphabet. No group grows with the data, and a pair crosses the network once.

A word's root follows forms, which grow at least RATIO times in count with every step, by doubling the steps.

Nulls: a null text has no words; with a null doc_id no run is changed. Repeated rows count again. Runs may be of any
length, and cost time in proportion to it. Ties of heavy children go to the smallest character, of forms to the smallest
word. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, stored, table

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A run is changed where its hash is divisible by this.
CHANGED = 199
#: Words of a shard at most, entries of a task's counter, and rows of nodes that may be broadcast.
SHARD, COUNTED, BROADCAST = 3_000, 1 << 18, 50_000
WILD = "\0"


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, changed: int = CHANGED) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case; a run that its hash selects loses one character first."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")  # a shorter one can't be a word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                seed = None if doc is None else zlib.crc32(f"{doc}:".encode())
                for word, times in Counter(runs.findall(text.encode().lower().decode())).items():  # bytes know A-Z only
                    if seed is not None and (h := zlib.crc32(word.encode(), seed)) % changed == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += times
                if len(counts) >= COUNTED:
                    yield out()
        if counts:
            yield out()

    return arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common(a: str, b: str) -> int:
    """Length of the common prefix, by bisection over slices."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def light(words: list[str]) -> list[list[tuple[int, str]]]:
    """For each of the sorted, distinct words the nodes at which it is light: (depth, heavy character)."""
    out: list[list[tuple[int, str]]] = [[] for _ in words]
    stack = [(0, len(words))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        d = common(words[lo], words[hi - 1])
        at = lo + (len(words[lo]) == d)
        runs = [(lo, at, "")] if at > lo else []
        while at < hi:
            c = words[at][d]
            end = bisect_left(words, words[at][:d] + chr(ord(c) + 1), at, hi)
            runs.append((at, end, c))
            at = end
        heavy = max((r for r in runs if r[2]), key=lambda r: (r[1] - r[0], -ord(r[2])))
        for begin, end, c in runs:
            if c != heavy[2]:
                for k in range(begin, end):
                    out[k].append((d, heavy[2]))
            if end - begin > 1:
                stack.append((begin, end))
    return out


def asked(word: str, d: int, heavy: str) -> tuple[list[str], str | None]:
    """What a word that is light at depth d looks for: whole words, and the wildcard's key."""
    head, rest = word[:d], word[d:]
    found = [head + heavy + rest]
    if not rest:
        return found, None
    found.append(head + heavy + rest[1:])
    if rest[:1] != rest[1:2]:
        found.append(head + rest[1:])
    return found, head + WILD + rest[1:]


def merged(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places of all pairs of the sorted, distinct words that are one edit apart, each once."""
    place, wild = {w: k for k, w in enumerate(words)}, defaultdict(list)
    for k, (w, nodes) in enumerate(zip(words, light(words), strict=True)):
        for d, heavy in nodes:
            whole, key = asked(w, d, heavy)
            for x in whole:
                if x in place:
                    yield k, place[x]
            if key is not None:
                wild[key].append(k)
    for met in wild.values():
        yield from combinations(met, 2)


def _shared(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.least(F.length(a), F.length(b)).alias("hi"))

    def halved(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.when(same, F.struct(mid.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), F.least(acc["hi"], F.greatest(mid - 1, acc["lo"])).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halved)["lo"]


def sharded(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n) -> stored word, n, shard, nodes: words of a shard share it as a prefix and are at most `shard`; nodes are those above it at which the word is light."""
    rows = stored(words.select("word", "n", F.lit(0).alias("deep"), F.expr("cast(array() as array<struct<d: int, heavy: string>>)").alias("nodes")), "spelling_words")
    while True:
        prefix = F.substring("word", F.lit(1), F.col("deep"))
        groups = rows.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("words"), F.min("word").alias("a"), F.max("word").alias("b"))
        large = stored(groups.where(F.col("words") > shard).select("prefix", _shared(F.col("a"), F.col("b")).alias("d")), "spelling_nodes")
        n = large.count()
        if not n:
            return rows.select("word", "n", prefix.alias("shard"), "nodes")
        # at most one node for `shard` words: broadcast while that is few, else joined by its key, which splits where it is hot
        small = (lambda df: F.broadcast(df)) if n <= BROADCAST else (lambda df: df)
        at = rows.withColumn("prefix", prefix).join(small(large), "prefix", "left").withColumn("c", F.when(F.col("d").isNotNull(), F.substring("word", F.col("d") + 1, F.lit(1))))
        children = at.where(F.col("c") != "").groupBy("prefix", "c").agg(F.count("*").alias("words"))
        heavy = children.groupBy("prefix").agg(F.min_by("c", F.struct(-F.col("words"), F.col("c"))).alias("heavy"))
        known = stored(large.join(heavy, "prefix"), "spelling_heavy")
        at = rows.withColumn("prefix", prefix).join(small(known), "prefix", "left").withColumn("c", F.when(F.col("d").isNotNull(), F.substring("word", F.col("d") + 1, F.lit(1))))
        here = F.array(F.struct(F.col("d").alias("d"), F.col("heavy").alias("heavy")))
        rows = stored(
            at.select("word", "n", F.when(F.col("c").isNotNull(), F.col("d") + F.length("c")).otherwise(F.col("deep")).alias("deep"), F.when(F.col("c") != F.col("heavy"), F.concat("nodes", here)).otherwise(F.col("nodes")).alias("nodes")),
            "spelling_words",
        )


def one_edit_pairs(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n), distinct words -> (word, n, near, near_n) for every pair that is one edit apart, once, in either direction."""
    schema = "word string, n long, near string, near_n long, whole string, wild string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []
        now = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("n", "near_n") else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        def local() -> Iterator[pa.RecordBatch]:
            rows = []
            for a, b in merged([w for w, _ in held]):
                rows.append((*held[a], *held[b], None, None))
                if len(rows) >= 10_000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

        for batch in batches:
            above = []
            for r in batch.to_pylist():
                if r["shard"] != now:
                    yield from local()
                    held, now = [], r["shard"]
                held.append((r["word"], r["n"]))
                for node in r["nodes"]:
                    whole, key = asked(r["word"], node["d"], node["heavy"])
                    above += [(r["word"], r["n"], None, None, x, None) for x in whole]
                    if key is not None:
                        above.append((r["word"], r["n"], None, None, None, key))
            if above:
                yield made(above)
        yield from local()

    dealt = sharded(words, shard).repartition("shard").sortWithinPartitions("shard", "word")
    found = stored(arrow(dealt, run, schema), "spelling_pairs")
    inside = found.where(F.col("near").isNotNull()).select("word", "n", "near", "near_n")
    every = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    across = found.where(F.col("whole").isNotNull()).select("word", "n", F.col("whole").alias("near")).join(every, "near").select("word", "n", "near", "near_n")
    meeting = found.where(F.col("wild").isNotNull()).groupBy("wild").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("met")).where(F.size("met") > 1)  # as many as the alphabet, at most
    each = meeting.select("met", F.posexplode("met").alias("k", "x")).select("x", F.explode(F.slice("met", F.col("k") + 2, F.size("met"))).alias("y"))
    return inside.unionByName(across).unionByName(each.select("x.word", "x.n", F.col("y.word").alias("near"), F.col("y.n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without circles -> (word, root), by doubling the steps until none is left."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        if not further.where("moved").limit(1).count():
            return further.select("word", "root")
        now = further.select("word", "root")


def variants(words: DataFrame, shard: int = SHARD, ratio: int = RATIO) -> DataFrame:
    """(word, n), distinct words -> word, n, n_near, form, form_n, root."""
    words = stored(words.select("word", "n"), "spelling_vocabulary")
    pairs = one_edit_pairs(words, shard)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rated = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best.near_n") >= ratio * F.col("n"), F.col("best")).alias("form")
    )
    rated = stored(rated.select("word", "n", "n_near", F.col("form.near").alias("form"), F.col("form.near_n").alias("form_n")), "spelling_forms")
    found = roots(rated.where(F.col("form").isNotNull()))
    return rated.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    words = counted(table(spark, sf_dir, "documents")).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def _sql() -> str:
    from .sharding import _crc_table

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive runs as (select doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-zÀ-ÿ]+')) w from documents),
each as (select doc_id, w, count(*) k from runs where length(w) >= 6 group by all),
coded as (select *, list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(doc_id || ':' || w)), '..'), lambda x: cast('0x' || x as bigint))) b from each),
hashed as (select *, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, list_extract({_crc_table()}, (xor(c, x) & 255) + 1)))) h from coded),
said as (select case when h % 199 = 0 then left(w, h % length(w)) || substring(w, h % length(w) + 2) else w end word, k from hashed),
v as (select word, cast(sum(k) as bigint) n from said where length(word) >= 6 group by word having sum(k) >= 5),
cut as (select word, i, left(word, i) || substring(word, i + 2) less from (select word, unnest(range(length(word))) i from v)),
pairs as (select a.word x, b.word y from cut a join cut b on a.i = b.i and a.less = b.less and a.word <> b.word
  union select c.word, v.word from cut c join v on c.less = v.word union select v.word, c.word from cut c join v on c.less = v.word),
near as (select x word, count(*) n_near, first(y order by o.n desc, y) form, max(o.n) form_n from pairs join v o on o.word = y group by x),
formed as (select v.word, v.n, coalesce(n_near, 0) n_near, case when form_n >= 5 * v.n then form end form, case when form_n >= 5 * v.n then form_n end form_n from v left join near using (word)),
walk as (select word, form, word as top, 0 as steps from formed union all select w.word, f.form, f.word, steps + 1 from walk w join formed f on w.form = f.word)
select f.word, f.form, w.root, f.n, cast(f.n_near as bigint) n_near, f.form_n from formed f join (select word, arg_max(top, steps) root from walk group by word) w using (word)
"""


OP13_SQL = _sql()
