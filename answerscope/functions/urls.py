"""URLs and citation sections, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import bound

# The headings that open an answer's list of sources, and what a URL looks like in text.
HEADINGS = r"links?[ \t]+cited|sumber[ \t]*&[ \t]*referensi[ \t]+link|\d+[ \t]+(?:referensi[ \t]+dan[ \t]+)?tautan[ \t]+sumber"
URL = r"""https?://[^\s\)\]\>"'`<]+"""
#: A heading alone on its line; greedy before it, so that the last one counts.
LAST_HEADING = rf"(?is)^(.*(?:^|\n)|)[ \t]*#{{0,4}}[ \t]*(?:{HEADINGS})[ \t]*\r?(?=\n|$)(.*)$"
#: The shortest redirect without its target: each one that wraps another takes so many characters at least.
LEAST_WRAP = len("http://google./search?q=")


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def has_citation_section(text: Column) -> Column:
    return text.rlike(LAST_HEADING)


def answer_body(text: Column) -> Column:
    """What stands before the last source heading; an error if there is none."""
    return F.when(has_citation_section(text), F.regexp_extract(text, LAST_HEADING, 1)).when(text.isNotNull(), F.raise_error(F.lit("no citation heading")).cast("string"))


def citation_section(text: Column) -> Column:
    return F.when(has_citation_section(text), F.regexp_extract(text, LAST_HEADING, 2)).when(text.isNotNull(), F.raise_error(F.lit("no citation heading")).cast("string"))


def urls_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def authority(url: Column) -> Column:
    """What stands between // and the next /, ? or #."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path without the parameters (after a semicolon) of its last part."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?((?:[^?#]*/)?[^?#;]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def domain_of(url: Column) -> Column:
    """Lower-case authority without one leading www.; a port stays."""
    return F.regexp_replace(F.lower(authority(url)), r"^www\.", "")


def decoded(part: Column) -> Column:
    """Form decoding; a broken escape stays as it is written."""
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def encoded(part: Column) -> Column:
    """Form encoding with - _ . ~ kept."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def pairs(q: Column) -> Column:
    """(key, value) of a query string's non-empty parts, decoded; a part without = has an empty value."""
    parts = F.filter(F.split(q, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))


def trimmed(url: Column) -> Column:
    return F.regexp_replace(url, r"[.,;:*\\]+$", "")


def unwrapped(url: Column) -> Column:
    """The target of a search redirect, however deeply nested, else the URL; either without punctuation at its end."""

    def step(u: Column, _: Column) -> Column:
        q = F.filter(pairs(query(u)), lambda p: (p["k"] == "q") & (p["v"] != ""))
        target = F.coalesce(F.get(q, F.lit(0))["v"], F.lit(""))
        hit = domain_of(u).startswith("google.") & (path(u) == "/search") & target.startswith("http")
        return F.when(hit, trimmed(target)).otherwise(u)

    most = F.sequence(F.lit(0), (F.length(url) / LEAST_WRAP).cast("int"))  # steps beyond the last redirect change nothing
    return F.when(F.lower(url).contains("google."), F.aggregate(most, trimmed(url), step)).otherwise(trimmed(url))


def _normalized(url: Column) -> Column:
    kept = F.filter(pairs(query(url)), lambda p: ~F.lower(p["k"]).startswith("utm_"))
    q = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    return F.concat(F.lit("https://"), domain_of(url), F.regexp_replace(path(url), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def normalize_url(url: Column) -> Column:
    """One spelling: https, lower-case host without www., no slash at the end, no fragment, no utm_ parameters."""
    return bound(unwrapped(url), _normalized)


def extract_citations(answers: DataFrame, section_col: str = "section") -> DataFrame:
    """answer_id, engine, rank, url_raw, url, domain: the first URL of each line, each page once, in order.

    An answer's list is settled inside its row, so nothing is shuffled.
    """
    first = F.filter(F.transform(F.split(section_col, "\n"), lambda x: F.regexp_extract(x, f"({URL})", 1)), lambda u: u != "")
    lists = answers.select("answer_id", "engine", first.alias("raws")).withColumn("urls", F.transform("raws", normalize_url))
    found = lists.select("answer_id", "engine", "raws", "urls", F.posexplode(F.array_distinct("urls")).alias("place", "url"))
    raw = F.get("raws", (F.array_position("urls", F.col("url")) - 1).cast("int"))
    return found.select("answer_id", "engine", (F.col("place") + 1).alias("rank"), raw.alias("url_raw"), "url", domain_of(F.col("url")).alias("domain"))


def wrapped_links(answers: DataFrame, section_col: str = "section") -> DataFrame:
    """(answer_id, url) of lines where any URL is a search redirect."""
    lines = answers.select("answer_id", F.explode(F.split(section_col, "\n")).alias("text"))
    found = lines.withColumn("urls", urls_in(F.col("text"))).where(F.size("urls") > 0)
    found = found.where(F.exists("urls", lambda u: u.contains("google.com/search")))
    return found.select("answer_id", normalize_url(F.element_at("urls", 1)).alias("url")).distinct()


def answer_id(prefix: Column, number: Column) -> Column:
    return F.format_string("%s-%02d", prefix, number)
