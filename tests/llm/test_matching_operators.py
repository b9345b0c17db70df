"""Operators 11 to 13 against brute force, over awkward rows, small blocks and shards, and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerscope.llm import catalog, hard_negatives, pattern_packing, spelling, word_ids
from tests.llm import edge

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return edge.write(spark, tmp_path_factory.mktemp("edge"))


# Word ids


def test_word_ids_are_the_librarys():
    ids = word_ids.word_ids(public_tokenizers.path(WORDS))
    rng = random.Random(1)
    texts = [t for c in word_ids.KNOWN for t in (c, f"a{c}b", f"{c}{c}1", f"!{c}'s", f" {c} x{c}")]
    texts += ["".join(rng.choice([*word_ids.KNOWN, *" abc'std!?1 " * 40]) for _ in range(60)) for _ in range(2000)]
    texts += ["", "  ", "<|endoftext|> a <|startoftext|>", "<|", "x" * 70_000, "中文 \U0001f642 café", "İstanbul ΟΔΟΣ", "a b\u0085c\x1cd", "é", "don't we'll 'S", "\x01 \x02 a"]
    texts += [t or "" for _, t, *_ in edge.documents()]
    assert ids.fast
    assert [i.tobytes() for i in ids.encode(texts)] == [ids.exact(t) for t in texts]


def test_only_sound_files_take_the_fast_path():
    base = [chr(c) for c in range(1000, 1256)]
    tokens = lambda merges: {t: n for n, t in enumerate([*base, *[c + word_ids.WORD_END for c in base], *[a + b for a, b in merges]])}
    a, b, c = base[:3]
    good = [(a, b), (a + b, c)]
    assert word_ids.sound(tokens(good), good)
    bad = [(b, c), (a, b), (a + b, c)]  # "abc" is cut into a and bc
    assert not word_ids.sound(tokens(bad), bad)
    assert not word_ids.sound(tokens(good), good[::-1])


# Packing by patterns


def test_patterns_are_all_of_few_documents():
    got = {tuple(r) for r in pattern_packing.patterns(np.array([1, 2, 3, 5, 8]), 8).tolist()}
    assert got == {(8, 0, 0), (5, 3, 0), (5, 2, 1), (3, 3, 2)}
    assert len(pattern_packing.patterns(np.zeros(0, int), 8)) == 0


def test_repeats_are_a_least_squares_optimum():
    """No pattern's count can be raised to come closer by more than rounding would undo."""
    rng = np.random.default_rng(3)
    counts = np.zeros(65)
    counts[1:] = rng.integers(0, 40, 64)
    shapes = pattern_packing.patterns(np.flatnonzero(counts), 64)
    x = pattern_packing.repeats(counts, shapes, 64)
    weight = np.where(np.arange(65) > 0, np.clip(np.arange(65) / 32, pattern_packing.LIGHT, 1), 0)
    a = np.zeros((65, len(shapes)))
    for k, s in enumerate(shapes):
        for v in s:
            a[v, k] += weight[v]
    r = counts * weight - a @ x
    slope = a.T @ r
    assert (x >= 0).all() and (r @ r <= pattern_packing.ROUNDED * (weight**2).sum() or slope.max() < 1e-2 * np.abs(a.T @ (counts * weight)).max())


@pytest.mark.parametrize("seed", range(8))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 50, 256])
    counts = Counter(max(1, min(window, int(rng.lognormvariate(math.log(window / rng.choice([2, 5, 20])), 1)))) for _ in range(rng.choice([0, 1, 5, 300, 4000])))
    used, ranks = defaultdict(list), defaultdict(set)
    for length, lo, hi, first, each, at in pattern_packing.plan(dict(counts), window):
        for r in range(lo, hi):
            j = r - lo
            used[first + j // each].append((at + j % each * length, length))
            assert r not in ranks[length]
            ranks[length].add(r)
    assert {k: len(v) for k, v in ranks.items()} == dict(counts) and all(v == set(range(len(v))) for v in ranks.values())
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    least = -(-sum(k * n for k, n in counts.items()) // window)
    assert sorted(used) == list(range(len(used))) and len(used) <= least + max(2, least // 50) + sum(n for k, n in counts.items() if 2 * k > window) // 2


def test_op11(spark, folder):
    got = [r.asDict() for r in catalog.QUERIES["op11_pattern_packing"](spark, folder).collect()]
    exact = word_ids.word_ids(public_tokenizers.path(WORDS)).exact
    want = Counter()
    for i, t, *_ in edge.documents():
        ids = np.append(np.frombuffer(exact(t or ""), "<u4"), np.uint32(0)).astype("<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            p = ids[at : at + 2048]
            want[i, n, at, len(p), zlib.crc32(p.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1


# Hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, score long, id string, block int"


def vectors():
    rng = random.Random(5)
    small = lambda n=4: [rng.choice([-1.0, -0.3, 0.004, 0.5, 0.9]) for _ in range(n)]
    rows = [(k, small(), rng.randint(0, 2)) for k in range(0, 700, 3)] + [(k, small(), rng.randint(0, 2)) for k in (100, 200, 400, 500)]
    rows += [(300, [1.0, 0.5, 0.5, 0.0], 1)] * 3  # a repeated anchor
    rows += [(900, None, 1), (1000, small(), None), (1100, [0.5, None], 1), (1200, [float("nan")], 1), (1300, [float("inf"), 1.0], 1), (1400, [], 1), (1500, small(2), 2), (1600, small(7), 1)]
    rows += [(None, small(), 1), (None, small(), 0), (1700, [3e9, -2e9, 1.0, 0.5], 0), (1800, [3e9, 1e9, 0.25], 0), (1900, [1e30, 1.0], 2), (-100, small(), 0), (2000, small(), 7)]
    return [(i, v, label, 1, "x", 2) for i, v, label in rows]


def brute_negatives(rows):
    used = []
    for i, v, label, *_ in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    cut = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    first = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = Counter()
    for k, (i, v, label) in enumerate(used):
        if i is None or i % 100:
            continue
        every = [(cut(sum(a * b for a, b in zip(v, w))), j, other) for n, (j, w, other) in enumerate(used) if n != k]
        for p, pid, _ in sorted((x for x in every if x[2] == label), key=first)[:5]:
            fits = [x for x in every if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p]
            for rank, (s, nid, _) in enumerate(sorted(fits, key=first)[:10], 1):
                out[i, pid, rank, nid, p, s] += 1
    return out


@pytest.mark.parametrize(("most", "queries"), [(16_384, 256), (7, 2)])
def test_hard_negatives_against_brute_force(spark, most, queries):
    rows = vectors()
    n = F.col("vec_id")
    label = F.when(F.coalesce(n % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mined(spark.createDataFrame(rows, VECTORS).repartition(3), n % 100 == 0, label=label, most=most, queries=queries).collect()
    assert Counter(map(tuple, got)) == brute_negatives(rows)
    assert len({r.anchor_id for r in got}) > 5


def test_op12(spark, tmp_path):
    rows = vectors()
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["op12_hard_negatives"](spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and dict(got.dtypes)["rank"] == "int"
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows)


# Spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def some_words(rng, alphabet, n, longest):
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)})


def test_merges_find_every_pair_once():
    rng = random.Random(3)
    for k in range(300):
        words = some_words(rng, "ab" if k % 2 else "abcé", rng.randint(0, 60), 7)
        got = Counter(tuple(sorted(p)) for p in spelling.merged(words))
        assert got == Counter((a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if near(words[a], words[b])), words


def test_words_are_light_at_few_nodes():
    words = some_words(random.Random(2), "abcdefgh", 5000, 9)
    assert max(map(len, spelling.light(words))) <= math.log2(len(words))


@pytest.mark.parametrize("shard", [2, 9, 100])
def test_pairs_across_shards(spark, shard):
    """Nodes above the shards: a third of the words below one prefix, and one very long shared prefix."""
    rng = random.Random(shard)
    words = sorted({*some_words(rng, "abc", 80, 6), *["hot" + w for w in some_words(rng, "abc", 60, 5)], *["z" * 3000 + w for w in some_words(rng, "xy", 20, 4)], "z" * 3000})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(3)
    sizes = spelling.sharded(df, shard).groupBy("shard").count().collect()
    assert max(r["count"] for r in sizes) <= shard and all(r.shard for r in sizes)
    got = Counter(tuple(sorted((r.word, r.near))) for r in spelling.one_edit_pairs(df, shard).collect())
    assert got == Counter((a, b) for k, a in enumerate(words) for b in words[k + 1 :] if near(a, b))


def brute_variants(docs):
    counts = Counter()
    for i, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = 1 if i is None else zlib.crc32(f"{i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out, forms = {}, {}
    for w, n in words.items():
        mine = sorted((x for x in words if x != w and abs(len(x) - len(w)) < 2 and near(x, w)), key=lambda x: (-words[x], x))
        if mine and words[mine[0]] >= 5 * n:
            forms[w] = mine[0]
        out[w] = (n, len(mine))
    for w, (n, k) in out.items():
        root = w
        while root in forms:
            root = forms[root]
        yield w, forms.get(w), root, n, k, words[forms[w]] if w in forms else None


def test_op13(spark, tmp_path):
    rng = random.Random(9)
    words = ["stations", "station", "Stations", "statxons", "statioms", "ÉTOILES", "étoiles", "étoilées", "overlong" * 50, "river", "rivers", "rivert", "riverts", "xrivers", "gardens", "gardenz", "gardynz"]
    weights = [300, 40, 60, 6, 1, 8, 60, 9, 30, 90, 700, 90, 12, 2, 600, 90, 12]
    docs = [(k % 150 if k % 7 else None, " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for k in range(300)] + [(1, None), (2, ""), (3, "stations " * 3000), (3, "stations " * 3000)]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["op13_spelling_variants"](spark, str(tmp_path))
    want = list(brute_variants(docs))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and Counter(map(tuple, got.collect())) == Counter(want)
    assert sum(f is not None for _, f, *_ in want) > 4 and any(f and r != f for _, f, r, *_ in want)


def test_tasks_send_partial_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 2)
    df = spark.createDataFrame([(k, "alphas betass gammas deltas") for k in range(40)], "doc_id long, text string").coalesce(1)
    assert {r.word: r.n for r in spelling.counted(df, changed=1 << 40).collect()} == dict.fromkeys(["alphas", "betass", "gammas", "deltas"], 40)
