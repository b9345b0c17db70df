"""The date of a page that says none in its structured data: all places that name one, weighed and reconciled.

Every date in a time element, a meta tag, the URL or the text is evidence for its day. A place counts once for a day, by
how much such places tell; days that several places agree on add up. A day outside of what is plausible is none. Of
equal days the one that the page names first counts; the URL comes before the page.
"""

from __future__ import annotations

import re
from datetime import date
from typing import NamedTuple

#: How much a place tells.
WEIGHTS = {"published element": 6, "published meta": 5, "element": 4, "url": 4, "said to be published": 3, "changed meta": 2, "text": 1}
PUBLISHED_META = frozenset("date dc.date dc.date.issued dcterms.created dcterms.issued publish-date publish_date pubdate og:published_time sailthru.date parsely-pub-date".split())
CHANGED_META = frozenset("article:modified_time og:updated_time last-modified dcterms.modified".split())
EARLIEST = date(1995, 1, 1)
MONTHS = {m: n for n, names in enumerate("jan feb mar apr may/mei jun jul aug/agu sep oct/okt nov dec/des".split(), 1) for m in names.split("/")}
_MONTH = "(" + "|".join(MONTHS) + r")[a-z]*\.?"
IN_TEXT = re.compile(rf"(?i)\b(?:(\d{{4}})-(\d{{2}})-(\d{{2}})|(\d{{1,2}})\s{{1,3}}{_MONTH}\s{{1,3}}(\d{{4}})|{_MONTH}\s{{1,3}}(\d{{1,2}}),?\s{{1,3}}(\d{{4}}))\b")
SAID = re.compile(r"(?i)\b(publish|posted|release|diterbit|dipublikasi|tayang|terbit|ver[öo]ffentlicht|publi[ée])")
IN_URL = re.compile(r"/(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?:\D|$)")
#: Characters before a date in the text that may say what it is.
BEFORE = 40


class Evidence(NamedTuple):
    day: date
    place: str
    at: int


def day(year: str, month: str | int, of: str) -> date | None:
    try:
        return date(int(year), int(month), int(of))
    except ValueError:
        return None


def in_text(text: str, start: int = 0) -> list[Evidence]:
    out = []
    for m in IN_TEXT.finditer(text):
        y1, m1, d1, d2, m2, y2, m3, d3, y3 = m.groups()
        found = day(y1, m1, d1) if y1 else day(y2, MONTHS[m2.lower()], d2) if y2 else day(y3, MONTHS[m3.lower()], d3)
        if found:
            said = SAID.search(text, max(0, m.start() - BEFORE), m.start())
            out.append(Evidence(found, "said to be published" if said else "text", start + m.start()))
    return out


def gathered(times: list[tuple[str, bool]], meta: dict[str, str], url: str, text: str) -> list[Evidence]:
    """times: (datetime, whether the element says that it is the publication) in order; meta: contents by lower-case name."""
    out = []
    iso = lambda value: next((e.day for e in in_text(value[:40])), None)
    for k, (value, published) in enumerate(times):
        if found := iso(value):
            out.append(Evidence(found, "published element" if published else "element", k))
    for names, place in ((PUBLISHED_META, "published meta"), (CHANGED_META, "changed meta")):
        out += [Evidence(found, place, k) for k, (name, value) in enumerate(meta.items()) if name in names and (found := iso(value))]
    if (m := IN_URL.search(url)) and (found := day(*m.groups())):
        out.append(Evidence(found, "url", -1))
    return out + in_text(text, 1000)


def best(evidence: list[Evidence], latest: date | None = None) -> tuple[str, int]:
    """(the day as text or "", its weight)."""
    places: dict[date, dict[str, int]] = {}
    for e in evidence:
        if EARLIEST <= e.day and (latest is None or e.day <= latest):
            at = places.setdefault(e.day, {})
            at[e.place] = min(e.at, at.get(e.place, e.at))
    rated = [(-sum(WEIGHTS[p] for p in at), min(at.values()), d) for d, at in places.items()]
    return (min(rated)[2].isoformat(), -min(rated)[0]) if rated else ("", 0)
