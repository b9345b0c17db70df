"""Page tables: source share of voice, readability, recency and schema types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .brand import ai_sov_weighted

# Schema types as substrings, and the date sources that count as structured.
ARTICLE, FAQ, ORG = "Article|BlogPosting|Report", "FAQPage", "Organization|BankOrCreditUnion|FinancialService|Corporation"
STRUCTURED = ("jsonld", "meta")


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def domain_part(url: Column) -> Column:
    """The third part of a URL between slashes, without one leading www."""
    return F.regexp_replace(F.get(F.split(url, "/"), F.lit(2)), r"^www\.", "")


def unreadable_reason(pages: DataFrame) -> Column:
    error = F.coalesce(F.col("fetch_error").cast("string"), F.lit(""))
    status = F.col("http_status").cast("string").try_cast("double").cast("int")
    return (
        F.when(F.col("is_readable").cast("string") == "true", "readable")
        .when(F.lower(optional(pages, "soft_404").cast("string")) == "true", "soft_404")
        .when(error != "", F.substring_index(error, ":", 1))
        .when(status.isNotNull() & (status != 200), F.concat(F.lit("http_"), status.cast("string")))
        .otherwise("too_little_text")
    )


def age_group(published: Column, run_date: str, bins: tuple[int, int, int]) -> Column:
    a, b, c = bins
    days = F.datediff(F.lit(run_date).cast("date"), published.cast("string").try_cast("date"))
    return F.when(days.isNull(), "unknown").when(days <= a, f"0-{a}").when(days <= b, f"{a + 1}-{b}").when(days <= c, f"{b + 1}-{c}").otherwise(f">{c}")


def one_a_url(pages: DataFrame) -> DataFrame:
    """One row for each url, so that joins by it never multiply rows: a readable one first, then the latest crawled, then the
    one with most words; what is left is told apart by the other columns, whatever their order. Rows without a url are one.

    The grouping is by the key of the joins that follow, and shares their exchange.
    """
    rest = [c for c in pages.columns if c != "url"]
    order = [F.coalesce(F.col("is_readable").cast("string") == "true", F.lit(False)).alias("a"), optional(pages, "crawled_at").cast("string").alias("b"), optional(pages, "n_words", "int").cast("long").alias("c"), F.to_json(F.struct(*sorted(rest))).alias("d")]
    chosen = pages.groupBy("url").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return chosen.select("url", "r.*")


def repeated_pages(pages: DataFrame) -> DataFrame:
    """What breaks the contract of one row a url: url, n."""
    return pages.groupBy("url").agg(F.count("*").alias("n")).where("n > 1")


def page_facts(pages: DataFrame, domains: DataFrame, run_date: str, bins: tuple[int, int, int]) -> DataFrame:
    """One row for each url: domain_type, reason, age groups on both bases, readable, kind and schema types."""
    used = [c for c in ("url", "is_readable", "soft_404", "fetch_error", "http_status", "published_date", "date_source", "content_kind", "schema_types", "crawled_at", "n_words") if c in pages.columns]
    pages = one_a_url(pages.select(*used))
    group = age_group(F.col("published_date"), run_date, bins)
    facts = pages.select(
        "url", domain_part(F.col("url")).alias("domain"), (F.col("is_readable").cast("string") == "true").alias("readable"),
        unreadable_reason(pages).alias("reason"), group.alias("group"),
        F.when(F.coalesce(optional(pages, "date_source"), F.lit("")).isin(*STRUCTURED), group).otherwise("unknown").alias("group_structured"),
        "content_kind", F.coalesce(F.col("schema_types").cast("string"), F.lit("")).alias("types"),
    )
    return facts.join(domains.select("domain", "domain_type"), "domain", "left")


def source_sov(mentions: DataFrame, pages: DataFrame, page_brand_counts: DataFrame) -> DataFrame:
    """Share of voice in answers and in the readable sources, weighted and raw, for brands of either side."""
    readable = pages.where(F.col("is_readable").cast("string") == "true").select("url").distinct()
    counted = page_brand_counts.join(readable, "url", "left_semi")
    shares = counted.withColumn("page_share", F.try_divide(F.col("count"), F.sum("count").over(Window.partitionBy("url"))))
    src = shares.groupBy("brand").agg(F.sum("count").alias("source_count"), F.countDistinct("url").alias("n_pages"), F.sum("page_share").alias("page_shares"))
    ai = mentions.groupBy("brand").agg(F.count("*").alias("ai_mentions")).join(ai_sov_weighted(mentions), "brand")
    # one row
    totals = counted.agg(F.countDistinct("url").alias("n_pages_with_brands"), F.sum("count").alias("all_counts")).join(F.broadcast(readable.agg(F.count("*").alias("n_readable_pages"))))
    totals = totals.join(F.broadcast(mentions.agg(F.count("*").alias("all_mentions"))))
    zero = lambda c, z=0: F.coalesce(F.col(c), F.lit(z))
    sov = src.join(ai, "brand", "full_outer").join(F.broadcast(totals)).select(
        "brand", zero("ai_sov_weighted", 0.0).alias("ai_sov_weighted"),
        F.coalesce(F.try_divide(F.col("page_shares"), F.col("n_pages_with_brands")), F.lit(0.0)).alias("source_sov"),
        F.coalesce(F.try_divide(zero("ai_mentions"), F.col("all_mentions")), F.lit(0.0)).alias("ai_sov"),
        F.coalesce(F.try_divide(zero("source_count"), F.col("all_counts")), F.lit(0.0)).alias("source_sov_raw"),
        zero("ai_mentions").alias("ai_mentions"), zero("source_count").alias("source_count"), zero("n_pages").alias("n_pages"),
        "n_pages_with_brands", "n_readable_pages",
    )
    return sov.withColumn("sov_gap", F.col("ai_sov_weighted") - F.col("source_sov")).withColumn("sov_gap_raw", F.col("ai_sov") - F.col("source_sov_raw"))


def _cut(df: DataFrame, cut: str, value: str, extra: list[str], out: str, rows: Column | None = None) -> DataFrame:
    """Counts of extra for each value of a column and All, with shares of the value's rows. Null values only count in All. rows: how many rows a group of df stands for."""
    counts = df.groupBy(value, *extra).agg((F.count("*") if rows is None else F.sum(rows)).alias("c"))  # small
    both = counts.groupingSets([[F.col(value), *map(F.col, extra)], [*map(F.col, extra)]], F.col(value), *map(F.col, extra)).agg(F.sum("c").alias(out), F.grouping(value).alias("__all"))
    both = both.where((F.col("__all") == 1) | F.col(value).isNotNull()).select(F.lit(cut).alias("cut"), F.when(F.col("__all") == 1, F.lit("All")).otherwise(F.col(value)).alias("value"), *extra, out)
    by = Window.partitionBy("value", *extra[:-1])
    rows = both.withColumn("n", F.sum(out).over(by)).withColumn("share", F.col(out) / F.col("n"))
    return rows.where(F.col(extra[-1]).isNotNull())


def readability(facts: DataFrame, citations: DataFrame) -> DataFrame:
    """Reasons by domain type (of pages) and by engine (of citations)."""
    of_pages = _cut(facts, "domain_type", "domain_type", ["reason"], "count").withColumn("unit", F.lit("pages"))
    cited = citations.select("engine", "url").join(facts.select("url", "reason"), "url", "left")
    of_citations = _cut(cited, "engine", "engine", ["reason"], "count").withColumn("unit", F.lit("citations"))
    return of_pages.unionByName(of_citations).select("cut", "value", "reason", "count", "unit", "share", "n")


def recency(facts: DataFrame, citations: DataFrame) -> DataFrame:
    """Age groups of readable cited pages by engine and by domain type, over all dates and over structured ones."""
    cited = citations.select("engine", "url").join(facts.where("readable").select("url", "group", "group_structured", "domain_type"), "url")
    both = cited.unpivot(["engine", "domain_type"], ["group", "group_structured"], "basis", "group")
    both = both.withColumn("basis", F.when(F.col("basis") == "group", "all dates").otherwise("structured dates only"))
    counted = both.groupBy("engine", "domain_type", "basis", "group").agg(F.count("*").alias("rows"))  # small; both cuts are of it
    parts = [_cut(counted, cut, cut, ["basis", "group"], "citations", F.col("rows")) for cut in ("engine", "domain_type")]
    return parts[0].unionByName(parts[1]).select("cut", "value", "basis", "group", "citations", "share", "n")


def schema_flags(facts: DataFrame) -> DataFrame:
    """Shares of readable html pages with structured data, by domain type and All."""
    html = facts.where(F.col("readable") & (F.col("content_kind") == "html"))
    share = lambda c, name: F.avg(c.cast("double")).alias(name)
    types = F.col("types")
    rolled = html.rollup("domain_type").agg(
        F.count("*").alias("n"), share(types != "", "any_jsonld"), share(types.rlike(ARTICLE), "article"),
        share(types.rlike(FAQ), "faq"), share(types.rlike(ORG), "org"), F.grouping("domain_type").alias("__all"),
    )
    kept = rolled.where((F.col("__all") == 1) | F.col("domain_type").isNotNull())
    return kept.select(F.when(F.col("__all") == 1, "All").otherwise(F.col("domain_type")).alias("domain_type"), "n", "any_jsonld", "article", "faq", "org")
