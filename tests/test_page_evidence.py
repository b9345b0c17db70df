"""JSON-LD by VARIANT against the plain walk, and dates by evidence."""

import json
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from answerscope.functions import evidence, jsonld, pages


def node(rng, depth):
    r = rng.random()
    if depth == 0 or r < 0.2:
        return rng.choice(["x", "[1]", '{"@type":"Fake"}', 5, True, None, "2024-01-01"])
    if r < 0.4:
        return [node(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    out = {}
    for k in rng.sample(["zeta", "@type", "alpha", "datePublished", "@graph", "mid"], rng.randint(0, 5)):
        plain = rng.random() < 0.8
        out[k] = rng.choice(["Article", ["Report", "FAQPage"], []]) if k == "@type" else rng.choice([f"2024-02-{rng.randint(1, 28):02}", "soon", ""]) if k == "datePublished" and plain else node(rng, depth - 1)
    return out


def test_variants_are_walked_like_plain_json(spark):
    rng = random.Random(1)
    deep = "leaf"
    for k in range(26):  # 52 levels
        deep = {"@graph": [deep, {"datePublished": f"2020-01-{k + 1:02}"}], "@type": f"T{k % 5}"}
    values = [[node(rng, 4) for _ in range(rng.randint(0, 2))] for _ in range(50)] + [[deep]]
    script = "<script data-x=1 type={}>{}</script>".format
    html = ["<head>" + "".join(script(rng.choice(["'application/ld+json'", '"Application/LD+json"', "application/ld+json"]), json.dumps(v)) for v in vs) + script('"application/ld+json"', "{broken") + script("text/plain", '{"@type": "No"}') for vs in values]
    df = spark.createDataFrame([(str(k), h) for k, h in enumerate(html)] + [("none", None), ("plain", "<p>x</p>")], "url string, html string")
    iso = lambda dates: [d for d in dates if re.match(r"\d{4}-\d\d-\d\d", d)]
    got = {r.page: (r.types, iso(r.dates)) for r in jsonld.walked(df, "url", F.col("html")).collect()}
    for k, vs in enumerate(values):
        found = [pages.walk_jsonld(v) for v in vs]
        assert got.get(str(k), ([], [])) == (sorted({t for ts, _ in found for t in ts}), iso([d for _, ds in found for d in ds])), vs
    rows = {r.url: r for r in jsonld.fields(df).collect()}
    assert len(rows) == len(values) + 2 and (rows["none"].types, rows["none"].date_source) == ([], "")


META = "<meta {}>".format


@pytest.mark.parametrize(("tag", "found"), [
    (META("property='article:published_time' content='2025-01-02T03:00'"), "2025-01-02"), (META('content="2025-01-02" name="article:published_time"'), "2025-01-02"), (META("property=article:published_time content=2025-01-02"), "2025-01-02"),
    (META("property='article:published_timer' content='2025-01-02'"), ""), (META("property='article:published_time' content='soon'"), ""),
])
def test_meta_dates(spark, tag, found):
    r = jsonld.fields(spark.createDataFrame([("u", tag)], "url string, html string")).first()
    assert (r.published_date, r.date_source) == (found, "meta" if found else "")


def published(html, url="https://x.example/a"):
    d = pages.extract_html(html, url)
    return d["published_date"], d["date_source"]


def test_dates_by_evidence():
    assert published("<time datetime='2025-03-01'>a</time><time class='published' datetime='2025-02-01'>b</time>") == ("2025-02-01", "htmldate")
    assert published("<p>On 4 May 2024 and 5 May 2024.</p>", "https://x.example/2024/05/05/tea") == ("2024-05-05", "htmldate")
    assert published("<p>Since March 3, 2020.</p><p>Diterbitkan: 17 Agustus 2021</p>") == ("2021-08-17", "htmldate")
    assert published("<meta name='article:modified_time' content='2025-06-06'><p>Posted 1 June 2025</p>") == ("2025-06-01", "htmldate")
    assert published("<p>31 February 2024, 2024-13-01, 1 May 1066, 12/03/2024</p>") == ("", "")
    assert published("<script type='application/ld+json'>{\"datePublished\": \"2001-02-03\"}</script><time datetime='2025-03-01'>a</time>") == ("2001-02-03", "jsonld")
    later = evidence.gathered([("2030-01-01", True)], {}, "", "4 May 2024")
    assert evidence.best(later) == ("2030-01-01", 6) and evidence.best(later, date(2026, 1, 1)) == ("2024-05-04", 1)
    assert evidence.best([]) == ("", 0)


def test_titles_are_decoded_once():
    title = lambda t: pages.extract_html(f"<title>{t}</title>", "")["title"]
    assert title("a &amp;lt; b &amp;amp; c &lt;") == "a &lt; b &amp; c <"
    assert title("black&amp") == "black&"  # a reference that HTML knows without its semicolon


def test_jsonld_query_reads_whole_pages(spark):
    """Titles, words and both parts of a graph, as in the query's first form."""
    from pathlib import Path

    from answerscope.queries import queries

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test data")
    rows = {r.n_words: r for r in queries()["jsonld_fields"](spark, str(data)).collect()}
    assert len(rows) == 25 and rows[4].title.endswith(" & co")
    assert (rows[4].types, rows[4].published_date, rows[7].types, rows[6].date_source) == ("Corporation;NewsArticle;Thing", "2024-01-05", "Report", "meta")
