"""The data-quality report: small summary frames, written as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config
from .citation import ranked
from .facts import citations_per_answer
from .page import optional


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    """Nulls are empty cells."""
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(columns), "|" + "---|" * len(columns), *map(line, rows)])


def outcome(pages: DataFrame, min_words: int):
    """The report's wording of why a page counts or not (fixed values)."""
    status = F.col("http_status").cast("string").try_cast("double").cast("int")
    error = F.coalesce(F.col("fetch_error").cast("string"), F.lit(""))
    return (
        F.when(F.col("is_readable").cast("string") == "true", "readable")
        .when(F.lower(optional(pages, "soft_404").cast("string")) == "true", "soft 404 (error page with status 200)")
        .when(error != "", F.substring_index(error, ":", 1))
        .when(status.isNotNull() & (status != 200), F.concat(F.lit("HTTP "), status.cast("string")))
        .otherwise(f"fewer than {min_words} words of text")
    )


def crawl_outcomes(pages: DataFrame, min_words: int) -> DataFrame:
    return pages.select(outcome(pages, min_words).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("pages"))


def review_counts(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("alias").isNotNull() & F.col("decision").isNotNull()).groupBy("alias", "decision").agg(F.count("*").alias("hits"))


def readable_shares(pages: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: readable pages, pages, and the share of citations they have. A url is one page, readable if any of its rows is."""
    pages = pages.groupBy("url").agg(F.max((F.col("is_readable").cast("string") == "true").cast("double")).alias("ok"))
    ok = F.col("ok")
    whole = pages.agg(F.sum(ok).cast("long").alias("readable"), F.count("*").alias("pages"), F.avg(ok).alias("page_share"))
    of = citations.select("url").join(pages, "url").agg(F.avg("ok").alias("citation_share"))
    return whole.join(F.broadcast(of))  # one row each


def table_lines(df: DataFrame, names: list[str], order: list) -> DataFrame:
    """(place, line) of a Markdown table of df's rows, each made where the row is."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    head = df.sparkSession.createDataFrame([(-2, "| " + " | ".join(names) + " |"), (-1, "|" + "---|" * len(names))], "place long, line string")
    rows = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"), *[F.struct(*order).alias("by")])
    return head.unionByName(ranked(rows, [F.asc("by")], "place").select(F.col("place").cast("long").alias("place"), "line"))


def unreadable_pages(pages: DataFrame, min_words: int) -> DataFrame:
    return pages.where(F.col("is_readable").cast("string") != "true").select("url", outcome(pages, min_words).alias("reason"))


def report_lines(t: dict[str, DataFrame], cfg: Config, usual: int = 10) -> DataFrame:
    """(section, place, line) of the report. t: answers, citations, sentences, mentions, pages, ambiguous_hits, sentiment_spotcheck.

    Sums are single rows; lists of pages, answers and hits stay distributed, however long they are.
    """
    spark, e = t["answers"].sparkSession, cfg.expected_counts
    n = {k: t[k].count() for k in ("answers", "sentences", "mentions")}
    cited = t["citations"].agg(F.count("*"), F.countDistinct("url"), F.countDistinct("domain")).first()
    brands = t["mentions"].agg(F.countDistinct("brand")).first()[0]
    counts = [
        ("Answers", e.get("answers"), n["answers"]), ("Citations", e.get("citations"), cited[0]), ("Unique cited URLs", e.get("unique_urls"), cited[1]),
        ("Unique cited domains", e.get("domains"), cited[2]), ("Answer sentences", None, n["sentences"]), ("Brand mentions", None, n["mentions"]), ("Brands mentioned", None, brands),
    ]
    odd = citations_per_answer(t["citations"], usual)
    n_cited, n_odd = t["citations"].select("answer_id").distinct().count(), odd.count()
    shares = readable_shares(t["pages"], t["citations"]).first()
    percent = lambda x: "no data" if x is None else f"{100 * x:.1f}%"
    parts: list[str | DataFrame] = [
        "# Data quality report", f"Run date of all answers: {cfg.run_date}. Engines: {', '.join(cfg.engines)}.",
        "## Counts", markdown_table(["Item", "Expected", "Actual"], counts),
        "## Citations per answer", f"{n_cited - n_odd} of {n_cited} answers list exactly {usual} sources.",
        ranked(odd.select(F.concat(F.lit("- `"), "answer_id", F.lit("` has "), "n", F.lit(".")).alias("line")), [F.asc("line")], "place").select(F.col("place").cast("long").alias("place"), "line"),
        "## Crawl outcomes", f"{shares['readable']} of {shares['pages']} pages were readable ({percent(shares['page_share'])}); they have {percent(shares['citation_share'])} of all citations.",
        table_lines(crawl_outcomes(t["pages"], cfg.readable_min_words), ["Outcome", "Pages"], [-F.col("pages"), F.col("outcome")]),
        "Every unreadable page:", table_lines(unreadable_pages(t["pages"], cfg.readable_min_words), ["URL", "Reason"], [F.col("url")]),
        "## Ambiguous brand hits", table_lines(review_counts(t["ambiguous_hits"]), ["alias", "decision", "Hits"], [F.col("alias"), F.col("decision")]),
        "## Sentiment spot-check", table_lines(t["sentiment_spotcheck"], t["sentiment_spotcheck"].columns, [F.col(c) for c in t["sentiment_spotcheck"].columns]),
    ]
    out = None
    for k, part in enumerate(parts):
        if isinstance(part, str):
            part = spark.createDataFrame(list(enumerate([*part.split("\n"), ""])), "place long, line string")
        else:
            part = part.unionByName(spark.createDataFrame([((1 << 62), "")], "place long, line string"))
        part = part.select(F.lit(k).alias("section"), "place", "line")
        out = part if out is None else out.unionByName(part)
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """The report as text files, to be read in the order of their names."""
    lines.orderBy("section", "place").select("line").write.mode("overwrite").text(path)


def build_report(t: dict[str, DataFrame], cfg: Config, usual: int = 10) -> str:
    """The report as one text, for runs whose lists a person can read."""
    return "\n".join(r["line"] for r in report_lines(t, cfg, usual).orderBy("section", "place").toLocalIterator())
