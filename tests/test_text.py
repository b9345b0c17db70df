from time import perf_counter

import pytest
from pyspark.sql import functions as F

from answerscope.functions import entities, numbers, presentation, sentences, urls
from answerscope.functions.entities import Brand


def apply(spark, text, *fs):
    """The functions' results for one text."""
    return list(spark.createDataFrame([(text,)], "t string").select(*[f(F.col("t")).alias(f"c{k}") for k, f in enumerate(fs)]).first())


def split(spark, markdown):
    return apply(spark, markdown, lambda c: sentences.split_sentences(sentences.clean_lines(c)))[0]


#: One heading for each wording that opens a list of sources.
HEADINGS = ["## LINK CITED", "#### links  cited", "sumber&referensi link", "#Sumber & Referensi Links".removesuffix("s"), "3 tautan sumber", "  12 referensi dan tautan sumber  "]


@pytest.mark.parametrize("heading", HEADINGS)
def test_a_heading_splits_an_answer(spark, heading):
    body, section = apply(spark, f"Green tea wins.\n{heading}\n- https://guild.example/a", urls.answer_body, urls.citation_section)
    assert body.strip() == "Green tea wins." and section.strip() == "- https://guild.example/a"


def test_the_last_heading_splits(spark):
    body, section = apply(spark, "one\nlinks cited\ntwo\n# Links cited\nthree", urls.answer_body, urls.citation_section)
    assert body.strip().endswith("two") and section.strip() == "three"
    assert apply(spark, "link cited\nonly sources", urls.answer_body, urls.citation_section) == ["", "\nonly sources"]


def test_words_beside_a_heading_make_it_none(spark):
    assert apply(spark, "all links cited here\nx", urls.has_citation_section) == [False]
    with pytest.raises(Exception, match="no citation heading"):
        apply(spark, "tea without sources: https://guild.example", urls.answer_body)


def test_line_ends_of_any_system_read_alike(spark):
    lines = ["Tea.", "", "2 tautan sumber", "https://guild.example/a", ""]
    read = lambda end: apply(spark, end.join(lines), lambda c: urls.answer_body(urls.newlines(c)), lambda c: urls.citation_section(urls.newlines(c)))
    assert read("\n") == read("\r\n") == read("\r")


def nested(url, depth):
    from urllib.parse import quote

    for _ in range(depth):
        url = "https://www.google.com/search?q=" + quote(url, safe="")
    return url


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("HTTP://www.Guild.example/Leaf/?b=2", "https://guild.example/Leaf?b=2"),
        ("https://guild.example:8443/leaf///", "https://guild.example:8443/leaf"),
        ("https://guild.example/leaf;sort=up?x=1#top", "https://guild.example/leaf?x=1"),
        ("https://guild.example/?utm_campaign=spring&UTM_term=t&k=v", "https://guild.example?k=v"),
        ("https://guild.example/l?empty=&q=a+b%21*~", "https://guild.example/l?empty=&q=a+b%21%2A~"),
        ("https://guild.example/l):;", "https://guild.example/l)"),
        ("https://google.com/search?q=green+tea", "https://google.com/search?q=green+tea"),
        ("https://google.com/maps?q=https://guild.example", "https://google.com/maps?q=https%3A%2F%2Fguild.example"),
        ("https://paper.example", "https://paper.example"),
        *[(nested("https://www.paper.example/x/", n), "https://paper.example/x") for n in (1, 2, 3, 6, 9)],
    ],
)
def test_one_spelling_of_a_url(spark, raw, expected):
    assert apply(spark, raw, urls.normalize_url) == [expected]


def test_hosts_and_urls_in_text(spark):
    assert apply(spark, "https://www.Guild.example:81/a?b", urls.domain_of) == ["guild.example:81"]
    assert apply(spark, "(http://paper.example/x) or <https://forum.example/q>, say", urls.urls_in) == [["http://paper.example/x", "https://forum.example/q"]]


def test_a_page_is_cited_once_at_its_first_place(spark):
    section = "- https://paper.example/x\nno link\n- see https://www.guild.example/a/ and https://shop.example\n* http://paper.example/x/?utm_source=s\n* https://forum.example/q"
    df = spark.createDataFrame([("nor-01", "North", section), ("sou-01", "South", "nothing")], "answer_id string, engine string, section string")
    rows = urls.extract_citations(df).orderBy("rank").collect()
    assert [(r.rank, r.url, r.domain) for r in rows] == [(1, "https://paper.example/x", "paper.example"), (2, "https://guild.example/a", "guild.example"), (3, "https://forum.example/q", "forum.example")]
    assert [r.url_raw for r in rows][1] == "https://www.guild.example/a/"


def test_lines_with_a_search_redirect_are_marked(spark):
    section = f"- {nested('https://www.guild.example/a', 1)}\n- https://paper.example/x then {nested('https://shop.example', 1)}\n- https://forum.example"
    df = spark.createDataFrame([("sou-01", section)], "answer_id string, section string")
    assert {tuple(r) for r in urls.wrapped_links(df).collect()} == {("sou-01", "https://guild.example/a"), ("sou-01", "https://paper.example/x")}


ICON = "![site](https://www.google.com/s2/favicons?domain=guild.example)"
MARKDOWN = {
    "an icon hides the short line after it": (f"Tea is old.\n\n{ICON}\n\nThe Guild\n\nTea is green.", ["Tea is old.", "Tea is green."]),
    "or a long one that a count follows": (f"Tea is old.\n\n{ICON}\n\nA long report on the teas of the north\n\n+12\n\nTea is green.", ["Tea is old.", "Tea is green."]),
    "but no long line else": (f"{ICON}\n\nThis line has more than four words.\n\nShort one here", ["This line has more than four words.", "Short one here"]),
    "a site's name between leaves the icon in force": (f"{ICON}\n\nguild.co\n\nThe Guild\n\nLong enough to be kept as text.", ["Long enough to be kept as text."]),
    "buttons, rules and sites": ("Boil it.\n\nAdd to Favorites\n\n***\n\nteahouse.org\n\nPour it.", ["Boil it.", "Pour it."]),
    "items": ("- **Alder:** mild\n2) Birch, `strong`\n• Cedar", ["Alder: mild", "Birch, strong", "Cedar"]),
    "tables": ("| Tea | Minutes |\n|:---|---:|\n| Alder | 3 |\n| | |", ["Tea Minutes", "Alder 3"]),
    "links, images and escapes": ("Ask the [guild](https://guild.example) ![cup](c.png)about 2\\_3 cups.", ["Ask the guild about 2_3 cups."]),
    "breaks in cells": ("| Alder | first:<br>\n\n<br>- cold |", ["Alder first:", "cold |".removesuffix(" |")]),
    "wrapped lines": ("The leaves of the\nalder are\n  mild.\n\nNext:\nthe birch", ["The leaves of the alder are mild.", "Next: the birch"]),
    "wrapped items": ("1. Alder\n is mild\n2. Birch\n# Cedar\nis sweet", ["Alder is mild", "Birch", "Cedar is sweet"]),
    "bare numbers and signs": ("Start.\n\n7.\n\n–\n\nStop.", ["Start.", "Stop."]),
    "nothing": ("", []),
}


@pytest.mark.parametrize("name", MARKDOWN)
def test_markdown(spark, name):
    markdown, expected = MARKDOWN[name]
    assert split(spark, markdown) == expected


def test_where_sentences_end(spark):
    cases = {
        "It costs 4.5 p.a. and more. Dr. Leaf vs. Dr. Root (they say.) Nothing! “Why?” Nobody asks.": ["It costs 4.5 p.a. and more.", "Dr. Leaf vs. Dr. Root (they say.)", "Nothing!", "“Why?”", "Nobody asks."],
        "Buy no. 7 now. e.g. this. It is No. 1": ["Buy no. 7 now. e.g. this.", "It is No. 1"],
        "One? (Two!) three. \u0001 Four\u0001.  Five": ["One?", "(Two!) three. \u0001 Four\u0001.", "Five"],
        "St. St. St.": ["St. St. St."],
        "  ": [],
    }
    for text, expected in cases.items():
        assert apply(spark, text, sentences.split_paragraph) == [expected], text


def test_long_texts_take_time_in_proportion(spark):
    from time import perf_counter

    def seconds(n):
        began = perf_counter()
        text = "\n\n".join(f"Line {k} of tea. It goes on.\nand on" for k in range(n))
        assert len(split(spark, text)) == 2 * n
        hits = apply(spark, "Alder or alder, " * n, lambda c: entities.find_matches(c, [Brand("A", None, "t", ("alder", "alder or alder"))]))[0]
        assert len(hits) == n
        return perf_counter() - began

    seconds(100)
    assert seconds(8000) < 6 * seconds(2000) + 2


def test_sentences_frame(spark):
    df = spark.createDataFrame([("a", "Tea is old. Is it?\n\n- very old"), ("b", None)], "answer_id string, answer_body string")
    assert [tuple(r) for r in sentences.build_sentences(df).orderBy("sent_idx").collect()] == [("a", 0, "Tea is old.", 3), ("a", 1, "Is it?", 2), ("a", 2, "very old", 2)]


BRANDS = [
    Brand("Alder", None, "house", ("Alder", "Alder Tea House"), True),
    Brand("sip", "Alder", "shop", ("sip of Alder Tea", "Alder Tea", "sip"), True, ("sip",)),
    Brand("Old Birch", None, "shop", ("Old Birch", "Birch"), True, ("Birch",)),
    Brand("Øre+", None, "x", ("øre+",)),
]


def names(spark, text, **kw):
    hits = apply(spark, text, lambda c: entities.find_matches(c, BRANDS, **kw))[0]
    return [(entities.entries(BRANDS)[h["nth"]][1], h["start"]) for h in hits]


def test_matching(spark):
    assert names(spark, "Take a sip of Alder Tea today.") == [("sip of Alder Tea", 7)]
    assert names(spark, "Alder Tea House, Alder Tea, Alder") == [("Alder Tea House", 0), ("Alder Tea", 17), ("Alder", 28)]
    assert names(spark, "alder myAlder Alders ’Alder 'Alder Alder_") == []
    assert names(spark, "Alder's and Alder’s") == [("Alder", 0), ("Alder", 12)]
    assert names(spark, "Birch", unambiguous_only=True) == [] and names(spark, "Old Birch", unambiguous_only=True) == [("Old Birch", 0)]
    assert names(spark, "🙂 ØRE+ Øre+x éAlder") == [("øre+", 2)]
    assert names(spark, "") == []


def test_overlaps_are_settled_longest_first(spark):
    import random

    chain = [Brand("X", None, "t", ("a b", "b c d", "d a", "c d a b", "a"))]
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(40)) for _ in range(60)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", entities.find_matches(F.col("t"), chain).alias("h")).orderBy("k").collect()
    for text, row in zip(texts, got, strict=True):
        hits = []
        for nth, alias in enumerate(chain[0].aliases):  # as a scan from the left finds them
            at = text.find(alias)
            while at >= 0:
                hits.append((-len(alias), at, nth))
                at = text.find(alias, at + len(alias))
        kept = []
        for size, at, nth in sorted(hits):
            if all(at - size <= a or b <= at for a, b, _ in kept):
                kept.append((at, at - size, nth))
        assert [tuple(h) for h in row.h] == sorted(kept)


def test_rejected_hits_still_cover_shorter_ones_and_review_is_asked_for(spark):
    df = spark.createDataFrame([("a", 0, "Birch or Alder"), ("a", 1, "a sip")], "answer_id string, sent_idx int, text string")
    hits = entities.all_hits(df, BRANDS)
    decisions = spark.createDataFrame([("a", 0, "Birch", 0, "reject")], "answer_id string, sent_idx int, alias string, char_pos int, decision string")
    mentions, review = entities.decided(hits, decisions)
    assert [(r.brand, r.sub_brand, r.char_pos) for r in mentions.collect()] == [("Alder", "", 9)]
    assert [(r.alias, r.sentence) for r in review.collect()] == [("sip", "a sip")]
    with pytest.raises(entities.ReviewNeeded):
        entities.gated(hits, decisions)
    kept = decisions.union(spark.createDataFrame([("a", 1, "sip", 2, "keep")], decisions.schema))
    assert {(r.brand, r.sub_brand) for r in entities.gated(hits, kept).collect()} == {("Alder", ""), ("Alder", "sip")}


def test_brand_counts(spark):
    df = spark.createDataFrame([("u", "Old Birch beats Birch. A sip of Alder Tea? Alder!"), ("v", "")], "url string, text string")
    rows = {r.brand: r for r in entities.brand_counts(df, BRANDS).collect()}
    assert (rows["Old Birch"]["count"], rows["Alder"]["count"], rows["Old Birch"].first_pos_ratio) == (1, 2, 0.0)


def test_branded_prompts(spark):
    assert [apply(spark, t, lambda c: entities.names_any(c, BRANDS))[0] for t in ("is Alder good?", "which tea?")] == [True, False]


def test_dictionary_is_checked():
    with pytest.raises(ValueError):
        Brand("x", aliases=("a",), ambiguous_aliases=("b",))
    with pytest.raises(ValueError):
        entities.checked([Brand("x", parent="y")])


def test_numbers(spark):
    got = [spark.range(1).select(numbers.percent(F.lit(x))).first()[0] for x in (0.125, 0.145, 0.995, 0.5)]
    assert got == ["13%", "15%", "100%", "50%"]
    r = spark.range(1).select(numbers.half_up(F.lit(17.4499999), 1), numbers.half_up(F.lit(1234567.5)), numbers.half_up(F.lit(2.5)), numbers.listed(F.array(*map(F.lit, "abc"))), numbers.listed(F.array(F.lit("a")))).first()
    assert list(r) == ["17.4", "1,234,568", "3", "a, b and c", "a"]


def test_every_number_shown_has_a_fact(spark):
    texts = spark.createDataFrame([("Alder leads with 55% of 40 answers.",)], "text string")
    facts = spark.createDataFrame([("55",)], "number string")
    assert [r.number for r in numbers.unknown_numbers(texts, facts).collect()] == ["40"]


def test_presentation(spark):
    r = spark.range(1).select(presentation.contrast(F.lit("#000000"), F.lit("#FFFFFF")), presentation.contrast(F.lit("#777777"), F.lit("#ffffff"))).first()
    assert list(r) == [pytest.approx(21), pytest.approx(4.478, abs=1e-3)]
    assert apply(spark, "aaa bbb ccc\n\nabcdefghij k", lambda c: presentation.line_count(c, 7)) == [5]


LONG = 1_000_000
LONG_LINES = {
    "dashes": "-" * LONG + "x", "rule": "- " * (LONG // 2), "signs": "_*" * (LONG // 2) + "x", "dots": "a." * (LONG // 2) + "x", "bars": "|" * LONG, "cells": "|---" * (LONG // 4) + "x", "breaks": "<br>" * (LONG // 4),
    "wrapped breaks": "<br> \n" * (LONG // 6) + "x", "blanks": "a" + " " * LONG + "x", "line feeds": "\n" * LONG + "x", "brackets": "[" * LONG, "images": "![" * (LONG // 2) + "](x", "open links": "[a](" * (LONG // 4), "one link": "[a](" * (LONG // 4) + ")",
    "quotes": "." + '"' * LONG + "x", "ticks": "`" * LONG, "stars": "*" * LONG,
}


@pytest.mark.parametrize("kind", LONG_LINES)
def test_long_lines_of_each_class_end_in_time(spark, kind):
    """None of them recurses, and none starts anew at each place to run to the same end."""
    began = perf_counter()
    got = apply(spark, LONG_LINES[kind], lambda c: sentences.split_sentences(sentences.clean_lines(c)))[0]
    assert perf_counter() - began < 20
    kept = {"dashes", "signs", "dots", "cells", "images", "open links", "quotes"}
    assert bool(got and len("".join(got)) > LONG // 2) == (kind in kept), kind


@pytest.mark.parametrize(("line", "rule", "table", "site"), [
    ("---", True, True, False), (" - - - ", True, False, False), ("-- ", False, False, False), ("*_-", True, False, False), ("-*x", False, False, False), ("|---|:---:|", False, True, False), ("|---|:--:|", False, False, False), ("---|---", False, True, False),
    ("||---", False, False, False), ("|--|", False, False, False), (":---", False, True, False), ("a.com", False, False, True), (" www.b-c.co.ID ", False, False, True), ("a..com", False, False, False), (".com", False, False, False), ("com", False, False, False), ("a.com x", False, False, False),
])
def test_line_classes(spark, line, rule, table, site):
    got = apply(spark, line, lambda c: F.array(sentences.is_rule(c), sentences.is_table_rule(c), sentences.is_site(c)))[0]
    assert got == [rule, table, site]


def test_leading_breaks_and_images_go_and_all_else_stays(spark):
    clean = lambda text: apply(spark, text, sentences.clean_body)[0]
    assert clean("<br>\n\n <br/>One\n<br />two<BR>three") == "One two three"
    assert clean("a [b](c) ![d](e) f [g] [h](") == "a b f [g] [h]("
    assert clean("![x](http://h/s2/favicons?a)\nChip\n\nA text that is long enough to stay") == "A text that is long enough to stay"


def test_a_line_is_cleaned_once(spark):
    """What is asked of a clean line is asked of one value, whatever the optimizer leaves twice."""
    plan = spark.createDataFrame([("# a",)], "t string").select(sentences.clean_lines(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("#{1,6}") == 1
