"""Sentences and the cited pages that hold most of their word pairs."""

from answerscope.operators.attribution import attributed

TEXTS = [("u1", "Green tea is grown on high hills. It rains."), ("u2", "Old tea is grown on high ground, and green tea too."), ("u3", "green tea"), ("u4", None)]
SENTENCES = [("a", 0, "Green tea is grown on hills!"), ("a", 1, "Nothing of it"), ("a", 2, "Rains"), ("a", 3, None), ("a", 4, ""), ("b", 0, "green tea"), ("b", 1, "Old old old tea is"), ("c", 0, "green tea")]
CITED = [("a", 1, "u1"), ("a", 2, "u2"), ("a", 3, "u2"), ("b", 1, "u2"), ("b", 2, "u3"), ("b", 3, "u1"), ("b", 4, "u4"), ("b", 5, "gone")]


def rows(spark, **kw):
    found = attributed(
        spark.createDataFrame(SENTENCES, "answer_id string, sent_idx int, text string"), spark.createDataFrame(CITED, "answer_id string, rank int, url string"), spark.createDataFrame(TEXTS, "url string, text string"), **kw
    )
    return {(r.answer_id, r.sent_idx): (r.best_url, round(r.score, 3), round(r.second_score, 3), r.attributed) for r in found.collect()}


def test_attribution(spark):
    got = rows(spark)
    assert got["a", 0] == ("u1", 0.8, 0.8, True)  # green tea, tea is, is grown, grown on of five pairs in both: the better rank wins
    assert got["a", 1] == (None, 0.0, 0.0, False) and got["a", 3] == got["a", 4] == (None, 0.0, 0.0, False)
    assert got["a", 2] == ("u1", 1.0, 0.0, True)  # one word
    assert got["b", 0] == ("u2", 1.0, 1.0, True)  # two words, by each; three pages tie
    assert got["b", 1] == ("u2", 0.667, 0.333, True)  # its distinct pairs: old old, old tea, tea is
    assert got["c", 0] == (None, 0.0, 0.0, False) and len(got) == len(SENTENCES)


def test_thresholds_and_stopwords(spark):
    assert rows(spark, threshold=0.9)["a", 0] == (None, 0.8, 0.8, False)
    assert rows(spark, stopwords=("is", "on"))["a", 0] == ("u1", 0.667, 0.667, True)  # green tea, tea grown of three pairs


def test_cited_pages_are_not_spread_out_by_gram(spark):
    """Long pages that many answers cite, against brute force; what goes through the plan is no row for each gram of each cited page."""
    import random

    draw = random.Random(3)
    text = lambda n: " ".join(f"w{draw.randrange(900)}" for _ in range(n))
    pages = {f"u{k}": text(4000) for k in range(6)}
    said = [(a, i, text(draw.randrange(2, 30))) for a in range(30) for i in range(4)]
    said += [(a, 4, " ".join(pages[f"u{a % 6}"].split()[a : a + 9])) for a in range(30)]
    cites = [(a, r, f"u{(a * r) % 6}") for a in range(30) for r in range(1, 5)]
    made = attributed(spark.createDataFrame(said, "answer_id long, sent_idx int, text string"), spark.createDataFrame(cites, "answer_id long, rank int, url string"), spark.createDataFrame(list(pages.items()), "url string, text string"))
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    has = {u: (set(t.split()), pairs(t.split())) for u, t in pages.items()}
    want = {}
    for a, i, t in said:
        w = t.split()
        own = pairs(w) if len(w) > 2 else set(w)
        rank = {u: min(r for b, r, v in cites if (b, v) == (a, u)) for b, _, u in cites if b == a}
        top = sorted(((-len(own & has[u][len(w) > 2]) / len(own), r, u) for u, r in rank.items() if own & has[u][len(w) > 2])) + [(0.0, 0, None)] * 2
        want[a, i] = (top[0][2] if -top[0][0] >= 0.3 else None, round(-top[0][0], 6), round(-top[1][0], 6))
    assert {(r.answer_id, r.sent_idx): (r.best_url, round(r.score, 6), round(r.second_score, 6)) for r in made.collect()} == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "explode(grams" not in plan
