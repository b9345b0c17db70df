"""What fetched pages say: keys, kinds, titles, dates, structured data, readability."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config
from . import evidence
from .sentences import strip
from .urls import path

# Schema types, soft-404 titles.
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting", "Report")
FAQ_TYPES = ("FAQPage",)
ORG_TYPES = ("Organization", "BankOrCreditUnion", "FinancialService", "Corporation")
SOFT_404 = r"(?iU)\b404\b|not found|error page|tidak ditemukan"
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
ISO = r"^(\d{4}-\d{2}-\d{2})"

EXTRACTED = "title string, text string, n_words int, published_date string, date_source string, schema_types array<string>, n_pages int, error string"


def cache_key(url: Column) -> Column:
    return F.sha1(url.cast("binary"))


def iso_date(x: Column) -> Column:
    """The date that a text starts with, else empty."""
    return F.regexp_extract(strip(x), ISO, 1)


def content_kind(content_type: Column, url: Column) -> Column:
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    pdf = ct.contains("pdf") | F.lower(path(url)).endswith(".pdf")
    return F.when(pdf, "pdf").when(ct.contains("html") | ct.contains("xml"), "html").otherwise("other")


def needs_render(status: Column, kind: Column, n_words: Column, min_words: int) -> Column:
    return F.coalesce((status == 200) & (kind == "html") & (n_words < min_words), F.lit(False))


def retry_wait(header: Column, default: int = 5, cap: int = 30) -> Column:
    """Seconds to wait; only whole numbers are read."""
    value = strip(F.coalesce(header, F.lit("")))
    return F.when(value.rlike(r"^\d+$"), F.least(F.coalesce(value.try_cast("long"), F.lit(cap)), F.lit(cap))).otherwise(default).cast("int")


def soft_404(title: Column) -> Column:
    return F.coalesce(title.rlike(SOFT_404), F.lit(False))


def html_title(html: Column) -> Column:
    """The first title, as it is written, white space folded."""
    return strip(F.regexp_replace(F.regexp_extract(html, TITLE, 1), r"(?U)\s+", " "))


def loaded_body(rendered: Column, raw: Column, was_rendered: Column) -> Column:
    """struct(body, source): the rendered page if there is one, else the raw one."""
    use = F.coalesce(was_rendered, F.lit(False)) & rendered.isNotNull()
    return F.when(use, F.struct(rendered.alias("body"), F.lit("rendered").alias("source"))).otherwise(F.struct(raw.alias("body"), F.when(raw.isNotNull(), "raw").otherwise("").alias("source")))


def walk_jsonld(node: object) -> tuple[list[str], list[str]]:
    """All types and publication dates of a JSON-LD value, in document order, without recursion limits."""
    types: list[str] = []
    dates: list[str] = []
    rest = [node]
    while rest:
        x = rest.pop()
        if isinstance(x, dict):
            kind = x.get("@type")
            types += [str(t) for t in kind] if isinstance(kind, list) else [str(kind)] if kind else []
            if x.get("datePublished"):
                dates.append(str(x["datePublished"]))
            x = [v for v in x.values() if isinstance(v, (list, dict))]
        if isinstance(x, list):
            rest += reversed(x)
    return types, dates


class _Reader(HTMLParser):
    """Title, metadata, JSON-LD blocks, dates in the page, and text outside of boilerplate."""

    SKIPPED = frozenset("script style noscript template svg nav header footer aside form button iframe select".split())
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.ld, self.meta, self.times, self.parts = "", [], {}, [], []
        self.skip, self.in_title, self.in_ld = 0, False, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            self.meta.setdefault((a.get("property") or a.get("name") or "").lower(), a.get("content") or "")
        elif tag == "time" and a.get("datetime"):
            said = " ".join(v or "" for k, v in attrs if k in ("itemprop", "class", "id", "property")).lower()
            self.times.append((a["datetime"], "pubdate" in a or "publi" in said))
        if tag == "title" and not self.title:
            self.in_title = True
        self.in_ld = tag == "script" and (a.get("type") or "").lower() == "application/ld+json"
        if self.in_ld:
            self.ld.append("")
        if tag in self.SKIPPED and tag not in self.VOID:
            self.skip += 1
        elif tag not in ("a", "b", "i", "em", "strong", "span", "code", "u", "small", "sup", "sub"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.in_ld = False
        if tag == "title":
            self.in_title = False
        if tag in self.SKIPPED and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if self.in_ld:
            self.ld[-1] += data
        elif self.in_title:
            self.title += data
        elif not self.skip:
            self.parts.append(data)


def _iso(text: str) -> str:
    m = re.match(r"\d{4}-\d{2}-\d{2}", text.strip())
    return m[0] if m else ""


def extract_html(html: str, url: str = "") -> dict:
    """Dates come from JSON-LD, then the article's meta tag, then from all other evidence on the page (functions.evidence)."""
    r = _Reader()
    r.feed(html)
    r.close()
    types: list[str] = []
    dates: list[str] = []
    for block in r.ld:
        try:
            t, d = walk_jsonld(json.loads(block))
        except ValueError:
            continue
        types, dates = types + t, dates + d
    lines = (" ".join(x.split()) for x in "".join(r.parts).split("\n"))
    text = "\n".join(x for x in lines if x)
    found = [("jsonld", dates), ("meta", [r.meta.get("article:published_time", "")])]
    published, source = next(((d, name) for name, options in found for o in options if (d := _iso(o))), ("", ""))
    if not published:
        published, _ = evidence.best(evidence.gathered(r.times, r.meta, url, text))
        source = "htmldate" if published else ""
    return {"title": " ".join(r.title.split()), "text": text, "n_words": len(text.split()), "published_date": published, "date_source": source, "schema_types": sorted(set(types)), "n_pages": None, "error": ""}


def extracted(bodies: DataFrame, pdf_max_pages: int = 300) -> DataFrame:
    """url, content_kind, encoding and body (binary) -> url and EXTRACTED. An error is a row, not a failure."""
    from ..sources.pdf import extract_pdf

    names = ["url", *[c.split()[0] for c in EXTRACTED.split(", ")]]

    def one(url: str, kind: str, encoding: str, body: bytes | None) -> dict:
        empty = {"title": "", "text": "", "n_words": 0, "published_date": "", "date_source": "", "schema_types": [], "n_pages": None, "error": ""}
        if body is None:
            return empty
        try:
            if kind == "html":
                return extract_html(bytes(body).decode(encoding or "utf-8", errors="replace"), url)
            if kind == "pdf":
                return empty | extract_pdf(bytes(body), pdf_max_pages)
        except Exception as e:  # whatever a page holds, the others go on
            return empty | {"error": f"extract_error: {type(e).__name__}"}
        return empty

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [one(*r) for r in f[["url", "content_kind", "encoding", "body"]].itertuples(index=False)]
            out = pd.DataFrame(rows, columns=names[1:])
            out["n_pages"] = out["n_pages"].astype("Int32")
            out.insert(0, "url", f["url"].to_numpy())
            yield out

    return bodies.select("url", "content_kind", "encoding", "body").mapInPandas(run, f"url string, {EXTRACTED}")


def page_rows(meta: DataFrame, found: DataFrame, cfg: Config) -> DataFrame:
    """The pages table from crawl metadata and what was extracted. A guessed date near the crawl is no publication date."""
    j = meta.join(found, "url", "left")
    published, source = F.coalesce("published_date", F.lit("")), F.coalesce("date_source", F.lit(""))
    crawled = F.substring("fetched_at", 1, 10).try_cast("date")
    near = (source == "htmldate") & F.coalesce(F.abs(F.datediff(crawled, published.try_cast("date"))) <= cfg.near_crawl_days, F.lit(False))
    types = F.array_sort(F.array_distinct(F.coalesce("schema_types", F.expr("cast(array() as array<string>)"))))
    has = lambda names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    soft, words = soft_404(F.col("title")), F.coalesce("n_words", F.lit(0))
    error = F.when(F.coalesce("error", F.lit("")) != "", F.col("error")).otherwise(F.coalesce("fetch_error", F.lit("")))
    return j.select(
        "url", "final_url", "http_status", error.alias("fetch_error"), "content_kind",
        (F.coalesce(F.col("http_status") == 200, F.lit(False)) & (words >= cfg.readable_min_words) & ~soft).alias("is_readable"), soft.alias("soft_404"),
        F.coalesce("title", F.lit("")).alias("title"), words.alias("n_words"), "n_pages",
        F.when(near, "").otherwise(published).alias("published_date"), F.when(near, "htmldate_near_crawl").otherwise(source).alias("date_source"),
        F.array_join(types, ";").alias("schema_types"), has(ARTICLE_TYPES).alias("has_article_schema"), has(FAQ_TYPES).alias("has_faq_schema"), has(ORG_TYPES).alias("has_org_schema"),
        F.col("fetched_at").alias("crawled_at"),
    )
