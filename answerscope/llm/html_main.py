"""Operator 7: the main text of a page, as its best-scoring stretch of words and tags.

A page is a row of tokens: words by where they stand (in the article, its links included; beside it; or, on a page
without one, in a link or not), start tags by name, and boilerplate elements, which count as one token each. Words of
content score positive, tags and obstacles negative; every score is learned from labelled pages. One linear scan finds
the contiguous stretch of largest score (the first of several, without tokens at its ends that add nothing). A page with
words in article or main and beside them has two readings, with and without these elements, and the one whose stretch
scores more is taken. All its words are the text; references are decoded, white space inside a block becomes one space, and blocks are joined by line
feeds in page order. Nothing in the stretch is dropped but boilerplate elements.

What is boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments, hidden parts, ...) is learned
from the same pages: each element's name and the words of its class, id and role, in the article and outside of it, have
log-odds, and an element whose sum is positive is boilerplate with all it holds. Labelled pages are generated by rule in
many templates (pages()), beside a few that are written out.

Formulas, drawings' labels and fallback text stay; titles of pages and drawings, and the text of iframe, noscript,
script, style, template and textarea don't.

Nulls: null and empty html give "" (n_chars 0), as do pages without content words. Repeated rows get equal results; an
empty table gives no rows; other columns are not read. Broken markup (unclosed elements, comments, scripts, references)
is read to the end of the page; every step is linear in the html.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title".split())
#: Text to its end tag, without tags or references, that is shown as it stands.
LITERAL = "xmp"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul xmp".split()
)
CLOSES = {  # a start tag ends an open element of these, not beyond the stops
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "body": (("head",), ("html",)),
}
#: An open p outside of these isn't ended by a block in them.
KEEPS_P = BLOCKS - {"p"} | {"object", "button", "svg", "math"}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TAG_END = re.compile(r"""[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*>""")
HINT_WORD = re.compile(r"[a-z]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: With these a class says that something has or lacks such a part, not that it is one.
RELATIONS = frozenset("has no with without enabled disabled open closed".split())
WORD, TAG = 0, 1
#: Whether an element is boilerplate, from its name, attributes, whether it is in an article, and its place in the page.
Judge = Callable[[str, str, bool, int], bool]


def traits(name: str, attributes: str, in_article: bool) -> list[str]:
    """What is learned of an element: its name and the words that name it, each as such and with its surroundings."""
    out = [f"<{name}>"]
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "style" and UNSEEN.search(value)):
            out.append("hidden")
        elif kind in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
            words = set(HINT_WORD.findall(value))
            out += sorted(words) if not words & RELATIONS else []
    return [*out, *[f"{x}@{'article' if in_article else 'page'}" for x in out]]


@lru_cache(1 << 14)
def _odds(name: str, attributes: str, in_article: bool) -> float:
    odds, prior, _ = learned()
    return prior + sum(odds.get(x, 0.0) for x in traits(name, attributes, in_article))


def judged(name: str, attributes: str, in_article: bool, at: int = 0) -> bool:
    return _odds(name, attributes, in_article) > 0


#: (WORD, place, text run, its place in the page) and (TAG, name, "", place); a run is of one element, undecoded.
Token = tuple[int, str, str, int]


def tokens(page: str, judge: Judge = judged) -> list[Token]:
    """A page's tokens in page order, in its first reading.

    An end tag is (TAG, "/name"), a boilerplate element (WORD, "boilerplate", its name). Words beside article and main are
    'outside' where there are words in these.
    """
    row = list(_placed(page, True, judge))
    articles = any(kind == WORD and part and place != "boilerplate" and run.strip() for kind, place, run, _, part in row)
    return [(kind, "outside" if articles and kind == WORD and not part and place != "boilerplate" else place, run, at) for kind, place, run, at, part in row]


def readings(page: str, judge: Judge = judged) -> Iterator[list[Token]]:
    """The page as its elements article and main tell, and, where words stand beside these, as one without them: they may
    hold teasers, comments or the like. Which reading holds is left to the scores."""
    first = tokens(page, judge)
    yield first
    if any(kind == WORD and place == "outside" and run.strip() for kind, place, run, _ in first):
        yield [(kind, place, run, at) for kind, place, run, at, _ in _placed(page, False, judge)]


def _placed(page: str, articles: bool, judge: Judge) -> Iterator[tuple[int, str, str, int, int]]:
    """Tokens with the number of the outermost article or main around a word (0: none; all are if not articles)."""
    stack: list[tuple[str, int]] = []  # with the number of open boilerplate elements outside of each
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by name
    keeps_p: list[int] = []  # and of KEEPS_P
    boiler, had_article, part = 0, False, 0
    at, n = 0, len(page)

    def pop_to(k: int) -> None:
        nonlocal boiler
        while len(stack) > k:
            name, boiler = stack.pop()
            opened[name].pop()
            if name in KEEPS_P:
                keeps_p.pop()

    def last(names: tuple[str, ...]) -> int:
        return max((opened[x][-1] for x in names if opened[x]), default=-1)

    def inside() -> bool:
        return bool(opened["article"] or opened["main"])

    def word(run: str, where: int) -> tuple[int, str, str, int, int]:
        here = part if articles and inside() else 0
        return WORD, "article" if here else "link" if opened["a"] else "plain", run, where, here

    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        else:
            closing = page.startswith("</", at)
            m = NAME.match(page, at + 1 + closing)
            if m:
                name = m[0].lower()
                done = TAG_END.match(page, m.end())
                end = done.end() if done else page.find(">", m.end()) + 1 or n
                attributes = page[m.end() : end]
                begun, at = at, end
                if closing:
                    if not boiler:
                        yield TAG, "/" + name, "", begun, 0
                    if opened[name]:
                        pop_to(opened[name][-1])
                    continue
                if name == LITERAL or name in RAW and not attributes.endswith("/>"):
                    close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                    after = page.find(">", close.start()) if close else -1
                    start, at = at, after + 1 if after >= 0 else n
                    if boiler:
                        continue
                    if name == LITERAL and judge(name, attributes, inside(), begun):
                        yield WORD, "boilerplate", name, begun, 0
                        continue
                    yield TAG, name, "", begun, 0
                    if name == LITERAL:
                        yield word(entities.escape(page[start : close.start() if close else n], quote=False), start)
                        yield TAG, "/" + name, "", at, 0
                    continue
                if name in BLOCKS and name not in ("html", "body") and opened["p"] and opened["p"][-1] > (keeps_p[-1] if keeps_p else -1):
                    pop_to(opened["p"][-1])
                if name in CLOSES:
                    ends, stops = CLOSES[name]
                    stop = last(stops)
                    while (k := last(ends)) > stop:
                        pop_to(k)
                if name in VOID:
                    if not boiler:
                        yield (WORD, "boilerplate", name, begun, 0) if judge(name, attributes, inside(), begun) else (TAG, name, "", begun, 0)
                    continue
                bad = judge(name, attributes, inside(), begun)
                # the page's main part or first article is no boilerplate, whatever wraps it
                first = not bad and (name == "main" or name == "article" and articles and not had_article)
                if bad and not boiler:
                    yield WORD, "boilerplate", name, begun, 0
                elif not boiler or first:
                    yield TAG, name, "", begun, 0
                opened[name].append(len(stack))
                if name in KEEPS_P:
                    keeps_p.append(len(stack))
                stack.append((name, boiler))
                had_article |= name in ("main", "article")
                part += name in ("main", "article") and len(opened["article"]) + len(opened["main"]) == 1
                boiler = 0 if first else boiler + bad
                continue
            if closing:
                end = page.find(">", at)
                at = n if end < 0 else end + 1
                continue
            end = page.find("<", at + 1)
            end = n if end < 0 else end
        if not boiler:
            yield word(page[at:end], at)
        at = end


# Labelled pages: rows of (label, html). True is content, False a boilerplate element, None other words beside the content.
Piece = tuple[bool | None, str]
_NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
_FOOT = "<footer><p>&copy; 2024 Example House. All rights reserved.</p><a href='/terms'>Terms</a></footer>"
_PARAS = "<p>The river rose in the night and the lower fields were under water by dawn.</p><p>Farmers moved <b>their cattle</b> to the hill, <a href='/map'>near the old mill</a>, and waited.</p>"
#: Written out, one for each common shape of page.
LABELLED: list[list[Piece]] = [
    [(None, "<html>"), (False, "<head><title>River</title></head>"), (None, "<body>"), (False, _NAV), (False, '<div class="ad">Buy new boots today</div>'), (True, "<article><h1>The river rose</h1>" + _PARAS + "</article>"), (False, _FOOT), (None, "</body></html>")],
    [(None, "<body>"), (False, "<div id='menu'><a href='/'>Start</a> <a href='/shop'>Shop</a></div>"), (True, "<main><h1>Opening hours</h1><p>We are open on weekdays from nine to five.</p><ul><li>Closed on holidays</li><li>Late on Friday</li></ul></main>"), (False, "<div class='cookie-notice'>This site uses cookies <button>OK</button></div>"), (None, "</body>")],
    [(False, _NAV), (True, "<div><h2>Minutes of the meeting</h2><p>The council met on Monday.</p><p>It approved the budget after a long debate.</p><blockquote>We are content, said the chair.</blockquote></div>"), (False, "<div class='comments'><p>First reader: I doubt it.</p><p>Second reader: me too.</p></div>"), (False, _FOOT)],
    [(False, "<table class=menu><tr><td><a href='1'>One</a></td><td><a href='2'>Two</a></td></tr></table>"), (True, "<p>Plain pages have long paragraphs and few tags, and most of their words are not links at all.</p><p>They were common once.</p>"), (False, "<form><label>Search</label><input name=q></form>")],
    [(False, "<header><a href='/'>Example</a><p>The daily page</p></header>"), (False, "<aside><p>Most read this week</p><a href='x'>Ten tips</a></aside>"), (True, "<article><header><h1>Bread</h1></header><p>Flour, water, salt and time.</p><p>Knead it well, and let it rest.<br>Bake it hot.</p></article>"), (False, "<section class='related'><h3>More</h3><a href='y'>Cakes</a></section>"), (None, "<div>Contact the publisher at the office in town.</div>")],
]
#: What the generated pages name boilerplate by: elements, and words of class, id and role.
ELEMENTS = "aside button datalist dialog fieldset footer form label menu nav select".split()
NAMES = (
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment commentlist comments complementary consent"
    " contentinfo cookie cookies dialog disqus footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice"
    " notification overlay pager pagination popup promo promoted promotion recommended related reply respond search share sharing sidebar signup"
    " skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets"
).split()
#: Names beside them that say nothing.
NEUTRAL = "main site page top left right box wrap wrapper inner block item list area col row big small post story text section content".split()
VOCABULARY = "river field stone winter council market bridge harbour garden letter music window evening village teacher doctor paper number water light road forest bread summer engine captain island history answer question morning".split()
WRAPPERS = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article class='post'>", "</article></main>"), ("<div class='content'>", "</div>"), ("<div id='story'><div class='text'>", "</div></div>"), ("<section class='entry'>", "</section>"),
    ("", ""), ("<table><tr><td class='body'>", "</td></tr></table>"), ("<div class='page'><article>", "</article></div>"), ("<center>", "</center>"), ("<div><div><div>", "</div></div></div>"), ("<div class='col left'><main role='main'>", "</main></div>"),
]


def prose(rng: random.Random, low: int, high: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(low, high))).capitalize() + "."


def block(rng: random.Random) -> str:
    """A piece of an article."""
    text = prose(rng, 8, 50)
    kind = rng.randrange(12)
    if kind == 0:
        return f"<h2 class='{rng.choice(NEUTRAL)}'>{prose(rng, 2, 6)}</h2><p>{text}</p>"
    if kind == 1:
        return f"<ul>{''.join(f'<li>{prose(rng, 3, 12)}</li>' for _ in range(3))}</ul>"
    if kind == 2:
        return f"<blockquote><p>{text}</p></blockquote>"
    if kind == 3:
        return f"<figure><img src=x><figcaption>{prose(rng, 3, 9)}</figcaption></figure><p>{text}</p>"
    if kind == 4:
        return f"<table><tr><th>{prose(rng, 1, 2)}</th><td>{prose(rng, 1, 4)}</td></tr><tr><td>{prose(rng, 1, 2)}</td><td>{prose(rng, 1, 4)}</td></tr></table><pre>{text}</pre>"
    if kind == 5:
        return f"<p>{text} <a href='/x'>{prose(rng, 2, 5)}</a> {prose(rng, 3, 9)}<br>{prose(rng, 3, 9)}</p>"
    if kind == 6:
        return f"<div class='{rng.choice(NEUTRAL)}'><span class='{rng.choice(NEUTRAL)}'>{text}</span> <em>{prose(rng, 2, 5)}</em></div>"
    if kind == 7:
        return f"<section id='{'-'.join(rng.sample(NEUTRAL, 2))}'><p class='{rng.choice(NEUTRAL)}'>{text}</p></section>"
    if kind == 8:
        return f"<div>{text}</div><ul class='{' '.join(rng.sample(NEUTRAL, 2))}'><li>{prose(rng, 3, 12)}</li></ul>"
    link = f" <a href='/y'>{prose(rng, 1, 6)}</a> {prose(rng, 3, 20)}" if rng.random() < 0.6 else ""
    return f"<p>{text} <b>{prose(rng, 1, 3)}</b>{link}</p>"


def boilerplate(rng: random.Random, nth: int, in_article: bool) -> str:
    """A boilerplate element, the nth of all that name one."""
    links = " ".join(f"<a href='/{k}'>{prose(rng, 1, 3)}</a>" for k in range(rng.randint(0, 5)))
    inner = rng.choice([links or "Go", f"<p>{prose(rng, 2, 40)}</p>", f"<ul><li>{links}</li><li>{prose(rng, 1, 5)}</li></ul>", f"<h3>{prose(rng, 1, 4)}</h3><p>{prose(rng, 3, 25)}</p>"])
    kinds = len(NAMES) + len(ELEMENTS) + 4
    k = nth % kinds
    if k < len(NAMES):
        tag = rng.choice(["div", "div", "div", "section", "section", "ul", "p", "span", "li", "table"])
        words = [NAMES[k], *rng.sample(NEUTRAL, rng.randint(0, 2))]
        rng.shuffle(words)
        how = rng.choice(["class", "class", "id", "role"])
        return f"<{tag} {how}='{rng.choice(['-', '_', ' ']).join(words)}'>{links or prose(rng, 1, 20) if tag in ('p', 'span', 'ul', 'li', 'table') else inner}</{tag}>"
    if k < len(NAMES) + len(ELEMENTS):
        tag = ELEMENTS[k - len(NAMES)]
        return f"<{tag}>{inner if tag not in ('label', 'button', 'select') else prose(rng, 1, 3)}</{tag}>"
    hidden = ["<div hidden>{}</div>", "<div style='display: none'>{}</div>", "<p aria-hidden='true'>{}</p>"]
    if k < kinds - 1 or in_article:
        return rng.choice(hidden).format(prose(rng, 2, 20))
    return rng.choice(["<header>{}</header>", "<div class='header'>{}</div>", "<section id='site-header'>{}</section>"]).format(inner)


def beside(rng: random.Random) -> str:
    """Words beside the content that nothing names."""
    return rng.choice(["<div>{}</div>", "<p>{}</p>", "<div><span>{}</span></div>", "<p><a href='/a'>{}</a> <a href='/b'>Next</a></p>", "<ul><li><a href='/a'>{}</a></li><li><a href='/b'>More</a></li></ul>"]).format(prose(rng, 1, 7))


def pages(n: int, wrappers: list[tuple[str, str]] | None = None, seed: int = 7) -> list[list[Piece]]:
    """n generated pages, the wrappers in turn; the names of boilerplate go round, in articles and beside them."""
    rng, out, nth = random.Random(seed), [], [0, 0]
    wrappers = wrappers or WRAPPERS

    def next_one(in_article: bool) -> Piece:
        nth[in_article] += 1
        return False, boilerplate(rng, nth[in_article], in_article)

    def around() -> list[Piece]:
        found = [next_one(False) for _ in range(rng.randint(1, 4))] + [(None, beside(rng)) for _ in range(rng.choice([0, 0, 1, 2]))]
        rng.shuffle(found)
        return found

    for k in range(n):
        opening, closing = wrappers[k % len(wrappers)]
        title = f"<h1>{prose(rng, 2, 8)}</h1>"
        title = f"<header>{title}<p class='{rng.choice(NEUTRAL)}'>{prose(rng, 2, 6)}</p></header>" if ("article" in opening or "main" in opening) and rng.random() < 0.5 else title
        page: list[Piece] = [(None, "<html>"), (False, f"<head><title>{prose(rng, 1, 5)}</title></head>"), (None, "<body>"), *around(), (True, opening + title)]
        for _ in range(rng.randint(2, 8)):
            page.append((True, block(rng)))
            page += [next_one(True)] if rng.random() < 0.4 else []
        out.append([*page, (True, closing), *around(), (None, "</body></html>")])
    return out


def html_of(page: list[Piece]) -> str:
    return "".join(piece for _, piece in page)


def content_of(page: list[Piece]) -> str:
    return "".join(piece for label, piece in page if label)


def count_words(run: str) -> int:
    return len(run.split())


#: Generated pages that are learned from.
N_PAGES = 360


def fitted(examples: list[list[str]], bad: list[bool]) -> tuple[dict[str, float], float]:
    """Logistic regression: log-odds of each trait, and those of no trait at all."""
    place = {x: k for k, x in enumerate(sorted({x for e in examples for x in e}))}
    x, y = np.zeros((len(examples), len(place) + 1)), np.array(bad, float)
    for row, e in zip(x, examples, strict=True):
        row[[place[t] for t in e]] = 1
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):  # Newton's
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w += np.linalg.solve(curve, x.T @ (y - p) - RIDGE * w)
    return dict(zip(place, w[:-1].tolist(), strict=True)), float(w[-1])


def learn(labelled: list[list[Piece]]) -> tuple[dict[str, float], float, dict[tuple[int, str], float]]:
    """(log-odds of traits, their prior, scores of tokens) from labelled pages."""
    examples: list[list[str]] = []
    bad: list[bool] = []
    rows = []
    for page in labelled:
        starts, at = [], 0
        for label, piece in page:
            starts.append((at, label))
            at += len(piece)
        roots = {at for at, label in starts if label is False}

        def label_at(place: int, starts=starts) -> bool | None:
            return starts[bisect_right(starts, place, key=lambda s: s[0]) - 1][1]

        def teacher(name: str, attributes: str, in_article: bool, at: int, roots=roots, label_at=label_at) -> bool:
            if at in roots or label_at(at) is not False:  # the parts of a boilerplate element tell nothing
                examples.append(traits(name, attributes, in_article))
                bad.append(at in roots)
            return at in roots

        list(_placed(html_of(page), True, teacher))
        inside = [at for at, label in starts if label]
        rows.append((tokens(html_of(page), lambda *e, roots=roots: e[3] in roots), label_at, max(inside), min(inside)))
    odds, prior = fitted(examples, bad)
    counts: dict[tuple[int, str], list[float]] = {}
    for row, label_at, last, first in rows:
        for kind, name, run, at in row:
            # of an obstacle or a tag: whether it lies within the content; of words: whether they are content
            inside = first <= at <= last if kind == TAG or name == "boilerplate" else bool(label_at(at))
            counts.setdefault((kind, name), [0.5, 0.5])[inside] += count_words(run) if kind == WORD else 1
    # a tag costs what its share beside the content says; how much that is in words is what finds the labelled content best
    share = {key: no / (no + yes) for key, (no, yes) in counts.items() if key[0] == TAG and not key[1].startswith("/")}
    words = {key: math.log(yes / no) for key, (no, yes) in counts.items() if key[0] == WORD}

    def misread(cost: float) -> int:
        w, wrong = words | {key: -cost * s for key, s in share.items()}, 0
        for row, label_at, _, _ in rows:
            a, b = best_stretch([score(token, w) for token in row])
            wrong += sum(count_words(run) for k, (kind, name, run, at) in enumerate(row) if kind == WORD and name != "boilerplate" and (a <= k < b) != bool(label_at(at)))
        return wrong

    cost = min(COSTS, key=misread)
    return odds, prior, words | {key: -cost * s for key, s in share.items()}


#: Steps of the elements' classifier, and the weight of its squares.
STEPS, RIDGE = 12, 0.1
#: What a tag that only occurs beside the content may cost, in the same unit as the words' log-odds.
COSTS = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0)


_model: list[tuple[dict[str, float], float, dict[tuple[int, str], float]]] = []


def learned() -> tuple[dict[str, float], float, dict[tuple[int, str], float]]:
    """Learned once, by the driver; Python workers are given it."""
    if not _model:
        _model.append(learn(LABELLED + pages(N_PAGES)))
    return _model[0]


def weights() -> dict[tuple[int, str], float]:
    return learned()[2]


def score(token: Token, w: dict[tuple[int, str], float]) -> float:
    """A run of words counts for each word, an obstacle and a start tag once (one never seen like a div); end tags only part blocks."""
    kind, name, run, _ = token
    if kind == TAG:
        return 0.0 if name.startswith("/") else w.get((kind, name)) or w[TAG, "div"]
    return w.get((kind, name), 0.0) * (count_words(run) if name != "boilerplate" else 1)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous stretch of the largest positive sum; the first of equal ones, and the shortest of those."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, found = total, (start, k + 1)
    return found


def extract(page: str | None) -> str:
    if not page:
        return ""
    found: list[tuple[float, list[Token]]] = []
    for row in readings(page):
        scores = [score(token, weights()) for token in row]
        start, end = best_stretch(scores)
        found.append((math.fsum(scores[start:end]), row[start:end]))
    _, stretch = max(found, key=lambda f: f[0])  # the first reading of equal ones
    blocks: list[list[str]] = [[]]
    for kind, name, run, _ in stretch:
        if kind == TAG:
            if name.removeprefix("/") in BLOCKS:
                blocks.append([])
            elif name == "br":
                blocks[-1].append(" ")
        elif name == "boilerplate":
            blocks.append([]) if run in BLOCKS else None
        else:
            blocks[-1].append(entities.unescape(run))
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def with_main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text as a column."""
    names = [c for c in pages.columns if c != out]
    kept = pages.select(*names)
    model = learned()  # some hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _model[:] = [model]
        for b in batches:
            texts = pa.array([extract(x.as_py()) for x in b.column(html_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], texts], names=[*names, out])

    return arrow(kept, run, StructType(kept.schema.fields + [StructField(out, StringType())]))


def op7_html_subsequence(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
