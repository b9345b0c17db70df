import random

import pytest

from answerscope.llm import html_main

PAGES = [
    ("<body class='has-sidebar nav-open'><div class='page with-ads'><p>Text body of the page.</p><div id=sidebar><p>side</p></div></div></body>", "Text body of the page."),
    ("<div class='banner'><main><p>Hello there my friend.</p></main></div>", "Hello there my friend."),
    ("<article><p>Story one two three.</p><section class='comments'><article class='comment'><p>I think that</p></article></section></article>", "Story one two three."),
    ("<div class='notice'>We use cookies</div><h1>T</h1><p>Some words. <a href=x>link text</a> end.</p><footer>f</footer>", "T\nSome words. link text end."),
    ("<p>a</p></div></div><p>b</p>", "a\nb"),
    ("<ul><li>one<li>two</ul>", "one\ntwo"),
    ("<p>x<p class=ad>buy<p>y", "x\ny"),
    ("<article><p>One two.</p><div class='ad'>" + "buy " * 50 + "</div><p>Three.</p></article>", "One two.\nThree."),
    ("<p>&lt;b&gt; &amp;amp; &eacute; &#8364; &am</p>", "<b> &amp; é € &am"),
    ("<p>a<br>b\n\t c&nbsp;d</p>", "a b c d"),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Body.</p><form>Name <input></form></article><aside>More</aside>", "Title\nBody."),
    ("<html><head><title>t</title><style>p{}</style></head><body>Body <script>var a = '<p>no</p>'</script>text", "Body text"),
]

# links at the edges of the article, and an article of links
PAGES += [
    ("<nav><a href=/>Home</a></nav><article><h1><a href=x>The linked headline</a></h1><p>Body of the story.</p></article>", "The linked headline\nBody of the story."),
    ("<article><h1>T</h1><p>Body of the story.</p><p><a href=x>A closing link of some words</a></p></article><footer>f</footer>", "T\nBody of the story.\nA closing link of some words"),
    ("<main><p>See also these.</p><ul><li><a href=a>One page</a></li><li><a href=b>Another page</a></li></ul></main>", "See also these.\nOne page\nAnother page"),
    ("<article><ul><li><a href=a>One page</a></li><li><a href=b>Another page</a></li></ul></article>", "One page\nAnother page"),
]

# names of elements that never open, and articles beside the main text
MAIN = "<div><h1>Title</h1><p>The main text stands here in a plain element, and it has some words more than the rest.</p></div>"
MAIN_TEXT = "Title\nThe main text stands here in a plain element, and it has some words more than the rest."
PAGES += [(f"<body>{x}{MAIN}</body>", MAIN_TEXT) for x in ("<!-- <article> -->", "<script>var a = '<main>'</script>", "<style>/* <article> */</style>", "<template><main>x</main></template>", "<form><textarea><article></textarea></form>")]
PAGES += [
    (f"{MAIN}<div class='comments'><article><p>I doubt it.</p></article><article><p>Me too.</p></article></div>", MAIN_TEXT),
    (f"{MAIN}<article><p>A teaser of a story.</p></article><article><p>One more of them.</p></article>", MAIN_TEXT + "\nA teaser of a story.\nOne more of them."),
    (f"<article>{MAIN}</article><div>Contact the office.</div>", MAIN_TEXT),
]

# formulas, preformatted and fallback text, and boilerplate that ends without an end tag
PAGES += [
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p><svg><title>t</title><text>Drawn label</text><path d='M0'/></svg><canvas>Chart of rain</canvas><object>Shown instead</object></article>", "Let x=1 hold.\nDrawn labelChart of rainShown instead"),
    ("<article><p>Code:</p><xmp>if a <b> c &amp; d</xmp><p>End.</p></article>", "Code:\nif a <b> c &amp; d\nEnd."),
    ("<article><p>Code:</p><xmp class=ad>buy</xmp><p>End.</p></article>", "Code:\nEnd."),
    ("<article><p>One two.</p><p class=ad>buy" + "<b>" * 12 + "now<p>Three four.</p></article>", "One two.\nThree four."),
    ("<article><ul><li>One" + " two" * 40 + "<li class=ad>buy" + "<b>" * 80 + "now<li>Three" + " four" * 40 + "</ul></article>", "One" + " two" * 40 + "\nThree" + " four" * 40),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert html_main.extract(page) == text


def test_weights_have_the_signs_of_the_method():
    w = html_main.weights()
    assert all(v < 0 for (kind, _), v in w.items() if kind == html_main.TAG)
    assert w[html_main.WORD, "article"] > 0 and w[html_main.WORD, "plain"] > 0 and w[html_main.WORD, "boilerplate"] < 0 and w[html_main.WORD, "outside"] < 0


def test_labelled_pages_are_read_back():
    for segments in html_main.LABELLED:
        inside = html_main.extract("".join(piece for kept, piece in segments if kept))
        assert html_main.extract("".join(piece for _, piece in segments)) == inside != ""


def test_any_markup_ends():
    rng = random.Random(1)
    parts = ["<", ">", "</", "<p>", "</p>", "<!--", "-->", "<script>", "</script>", "&amp", "word ", "<a href='", "'", '"', "<div class=ad>", "</div>", "<table><tr><td>", "<?x", "</ >"]
    for _ in range(500):
        html_main.extract("".join(rng.choice(parts) for _ in range(60)))
    for part in ("<!-- ", "<script>", "<b>", "<p class='", "</i>", "<a"):
        html_main.extract(part * 20_000)


def test_the_scan_against_brute_force():
    rng = random.Random(3)
    for _ in range(2000):
        scores = [rng.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randint(0, 14))]
        sums = [(sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best = max((s for s, *_ in sums), default=0)
        start, end = html_main.best_stretch(scores)
        assert sum(scores[start:end]) == max(best, 0)
        if best > 0:  # nothing at its ends could be left out
            assert all(sum(scores[start:k]) > 0 for k in range(start + 1, end + 1)) and all(sum(scores[k:end]) > 0 for k in range(start, end))


def words_read(pages, model=None):
    """(precision, recall, pages read exactly) by words, against what the content alone says."""
    import html
    import re
    from collections import Counter

    hit = got_n = want_n = exact = 0
    for page in pages:
        got = Counter(html_main.extract(html_main.html_of(page)).split())
        want = Counter(html.unescape(re.sub("<[^>]*>", " ", html_main.content_of(page))).split())
        hit, got_n, want_n, exact = hit + (got & want).total(), got_n + got.total(), want_n + want.total(), exact + (got == want)
    return hit / got_n, hit / want_n, exact / len(pages)


def test_templates_that_were_not_learned_from(monkeypatch):
    for k in range(3):
        known = [w for j, w in enumerate(html_main.WRAPPERS) if j % 3 != k]
        monkeypatch.setattr(html_main, "_model", [html_main.learn(html_main.LABELLED + html_main.pages(html_main.N_PAGES, known))])
        html_main._odds.cache_clear()
        precision, recall, _ = words_read(html_main.pages(100, html_main.WRAPPERS[k::3], seed=99))
        assert precision > 0.97 and recall > 0.99, (k, precision, recall)
    html_main._odds.cache_clear()


def test_without_the_scan_words_beside_the_content_stay(monkeypatch):
    pages = html_main.pages(150, seed=42)
    precision, recall, exact = words_read(pages)
    monkeypatch.setattr(html_main, "best_stretch", lambda scores: (0, len(scores)))
    without, same, fewer = words_read(pages)
    assert without < precision - 0.01 and fewer < exact - 0.2 and recall > 0.99 <= same, (precision, exact, without, fewer)
    page = "<article><p>The river rose in the night.</p></article><div>Contact the office in town.</div>"
    assert "Contact" in html_main.extract(page)
    monkeypatch.undo()
    assert html_main.extract(page) == "The river rose in the night."


def test_names_that_were_not_learned_from(monkeypatch):
    """Boilerplate whose names were never seen: what the scan leaves out of it, without loss of content."""
    names, scan = html_main.NAMES, html_main.best_stretch
    for half in (0, 1):
        monkeypatch.setattr(html_main, "NAMES", names[half::2])
        monkeypatch.setattr(html_main, "_model", [html_main.learn(html_main.LABELLED + html_main.pages(html_main.N_PAGES))])
        html_main._odds.cache_clear()
        monkeypatch.setattr(html_main, "NAMES", names[1 - half :: 2])
        pages = html_main.pages(100, seed=5)
        precision, recall, _ = words_read(pages)
        read = [html_main.extract(html_main.html_of(p)) for p in pages]
        monkeypatch.setattr(html_main, "best_stretch", lambda scores: (0, len(scores)))
        without, _, _ = words_read(pages)
        changed = sum(html_main.extract(html_main.html_of(p)) != text for p, text in zip(pages, read, strict=True))
        monkeypatch.setattr(html_main, "best_stretch", scan)
        assert precision > without + 0.06 and recall > 0.998 and changed > 75, (half, precision, without, recall, changed)
    html_main._odds.cache_clear()


def test_texts_against_brute_force():
    """The text is that of the best of all stretches of all readings."""
    from itertools import accumulate

    w = html_main.weights()
    short = [("<article><p>Short news.</p></article>", "<div><p>The river rose in the night and the lower fields were under water by dawn.</p></div>"), ("<main>Much more is said in here than beside it.</main>", "<p>Next</p>")]
    made = [html_main.html_of(p) for p in html_main.pages(40, seed=8)] + [x for a, b in short for x in (a + b, b + a, b + a + b)]
    for page in made:
        best, text = 0.0, ""
        for row in html_main.readings(page):
            sums = [0.0, *accumulate(html_main.score(t, w) for t in row)]
            top, a, b = max(((sums[b] - sums[a], -(b - a), -a) for a in range(len(row)) for b in range(a + 1, len(row) + 1)), default=(0.0, 0, 0))
            if top > best + 1e-9:
                best, text = top, " ".join(run for kind, name, run, _ in row[-b : -b - a] if kind == html_main.WORD and name != "boilerplate")
        import html

        assert html_main.extract(page).split() == html.unescape(text).split(), page
