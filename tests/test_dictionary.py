"""Dictionary matching at size: both ways against brute force, and plans that don't grow with the dictionary."""

import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from answerscope.functions import automaton, entities
from answerscope.functions.entities import Brand


def brute(text, brands):
    """As patterns find them one alias after the other, settled longest first over all hits."""
    hits = []
    for nth, (b, alias) in enumerate(entities.entries(brands)):
        fold = (lambda x: x) if b.case_sensitive else automaton.folded
        at, hay, needle = 0, fold(text), fold(alias)
        while (at := hay.find(needle, at)) >= 0:
            end = at + len(needle)
            word = lambda c: bool(regex.match(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍]", c))
            if (at == 0 or not (word(text[at - 1]) or text[at - 1] in "'’")) and (end == len(text) or not word(text[end])):
                hits.append((at, end, nth))
                at = end
            else:
                at += 1
    kept = []
    for h in sorted(hits, key=lambda h: (h[0] - h[1], h[0], h[2])):
        if all(h[1] <= k[0] or k[1] <= h[0] for k in kept):
            kept.append(h)
    return sorted(kept)


PARTS = ["Oak", "oak tree", "oak", "tree house", "House", "C++", "+", "++", ".net", "élan", "ÉLAN vital", "straße", "SS", "ß", "ſun", "Σίσυφος", "σίσυφοσ", "a b", "b a", "a", "b", "ıx", "ŷ"]


def some(seed):
    rng = random.Random(seed)
    brands = [Brand(f"B{k}", None, "t", tuple(rng.sample(PARTS, rng.randint(1, 3))), rng.random() < 0.4) for k in range(rng.randint(1, 12))]
    glue = [" ", " ", " ", "'", "’", "-", "_", "", ". ", "\U0001f642", "́", "Ⓐ", "‍"]
    texts = ["".join(rng.choice(PARTS if rng.random() < 0.8 else [p.upper() for p in PARTS]) + rng.choice(glue) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    return brands, [*texts, "", None]


@pytest.mark.parametrize("seed", range(4))
def test_both_ways_against_brute_force(spark, monkeypatch, seed):
    brands, texts = some(seed)
    df = spark.createDataFrame([(k % 50, k % 2, t) for k, t in enumerate(texts)], "answer_id int, sent_idx int, text string").unionByName(spark.createDataFrame([(0, 0, texts[0])] * 2, "answer_id int, sent_idx int, text string"))
    named = entities.entries(brands)
    want = Counter((i, text, named[nth][0].brand, named[nth][1], start) for i, text in [*((k % 50, t) for k, t in enumerate(texts)), *[(0, texts[0])] * 2] for start, _, nth in brute(text or "", brands))
    counted = lambda found: Counter((r.answer_id, r.text, r.brand, r.alias_matched, r.char_pos) for r in found.collect())
    assert want and counted(entities.all_hits(df, brands)) == want
    table = entities.aliases_of(spark, brands)
    assert counted(entities.all_hits(df, table)) == want
    monkeypatch.setattr(entities, "MOST_BYTES", 0)
    assert counted(entities.all_hits(df, brands)) == want
    with pytest.raises(ValueError, match="too many to broadcast"):
        entities.names_any(F.col("text"), brands)


def test_folding_is_that_of_patterns(spark):
    """Java's patterns compare letters one by one, without regard to case: the same letters fold together here."""
    chars = [c for c in map(chr, range(0x80, 0x2200)) if c.isalpha() and automaton.ODD.match(c)] + [*"aZzéÉßẞşŞ"]
    pairs = sorted({(c, d) for c in chars for d in (c.upper(), c.lower(), c.title(), c.upper().lower(), c.swapcase()) if len(d) == 1})
    rows = spark.createDataFrame(pairs, "c string, d string").select("c", "d", F.regexp_like("d", F.concat(F.lit("(?iU)^"), "c", F.lit("$"))).alias("same")).collect()
    assert not [r for r in rows if r.same != (automaton.folded(r.c) == automaton.folded(r.d))]


def test_fifty_thousand_aliases(spark, monkeypatch):
    """One plan for any dictionary; a text of many hits in time that grows with it."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    aliases = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(52_000)})
    many = [Brand(f"B{k}", None, "t", tuple(aliases[k : k + 10]), k % 3 == 0) for k in range(0, len(aliases), 10)]
    texts = [" ".join(rng.choice(aliases) if rng.random() < 0.3 else word() for _ in range(400)) for _ in range(40)]
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "answer_id int, sent_idx int, text string")
    found = entities.all_hits(df, many)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan(found)) < 2 * len(plan(entities.all_hits(df, many[:2])))
    got = Counter(map(tuple, found.drop("text").collect()))
    assert sum(got.values()) > 4000
    monkeypatch.setattr(entities, "MOST_BYTES", 0)
    assert Counter(map(tuple, entities.all_hits(df, entities.aliases_of(spark, many)).drop("text").collect())) == got


def test_an_empty_dictionary_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "a")], "answer_id int, sent_idx int, text string")
    assert entities.all_hits(df, []).count() == 0 and entities.all_hits(df.limit(0), [Brand("A", None, "t", ("a",))]).count() == 0


def test_review_meets_decisions_without_texts(spark):
    """Several texts at one place, the same one twice, and a place without an id; a text is joined once and not for each hit."""
    texts = [("a", 0, "a sip, a sip"), ("a", 0, "my sip"), ("b", 1, "sip sip"), ("b", 1, "sip sip"), (None, 0, "sip")]
    hits = entities.all_hits(spark.createDataFrame(texts, "answer_id string, sent_idx int, text string"), [Brand("S", None, "t", ("sip",), False, ("sip",))])
    known = spark.createDataFrame([("a", 0, "sip", 2, "keep"), ("b", 1, "sip", 0, None), ("b", 1, "sip", 0, "reject")], "answer_id string, sent_idx int, alias string, char_pos int, decision string")
    mentions, review = entities.decided(hits, known)
    assert Counter((r.answer_id, r.char_pos, r.sentence) for r in review.collect()) == Counter([("a", 9, "a sip, a sip"), ("a", 3, "my sip"), ("b", 4, "sip sip"), ("b", 4, "sip sip"), (None, 0, "sip")])
    assert [(r.answer_id, r.char_pos) for r in mentions.collect()] == [("a", 2)]
    plan = review._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "Join LeftOuter" not in plan


def test_batches_of_texts_are_bounded(spark):
    """Reading texts and looking for names in them sends a few MB at once to a Python worker, if the session has no bound of its own."""
    from answerscope.plans import shipping

    spark.conf.set(shipping.BATCH, shipping.SPARKS)
    entities.all_hits(spark.createDataFrame([("a", 0, "sip")], "answer_id string, sent_idx int, text string"), [Brand("S", None, "t", ("sip",))])
    assert int(spark.conf.get(shipping.BATCH).rstrip("b")) == shipping.BATCH_BYTES
