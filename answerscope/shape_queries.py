"""Named queries over inputs built from the driver's tables: readers and writers, crawling, Markdown, pages, review, report."""

from __future__ import annotations

from io import BytesIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import entities, jsonld, numbers, pages, sentences, urls
from .operators import brand, facts, quality
from .plans import bindings as B
from .plans.config import Config
from .plans.storage import new_path
from .sources import crawl, files
from .streaming.crawl_cache import CrawlCache
from .text_queries import BRANDS, docs

text = F.lit
joined = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def nations(s: SparkSession, d: str) -> DataFrame:
    return B.read(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


def csv_table(s: SparkSession, d: str) -> DataFrame:
    """Nulls, quotes, commas and line feeds in cells."""
    label = F.when(F.col("n_nationkey") % 5 != 0, joined(F.col("n_name"), ', "', F.col("n_regionkey").cast("string"), '"\n.'))
    df, path = nations(s, d).select("n_nationkey", label.alias("label")), new_path(s, "csv")
    files.write_csv(df, path)
    return files.read_csv(s, path, schema=df.schema)


def json_lines(s: SparkSession, d: str) -> DataFrame:
    df = nations(s, d).select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, joined(F.col("n_name"), '"\\\n')).alias("label"), (F.col("n_nationkey") / 8).alias("part"))
    path = new_path(s, "json")
    files.write_json(df, path)
    return s.read.schema(df.schema).json(path)


DICTIONARY = """
- {brand: Alder, type: house, aliases: [Alder, Alder Tea House], case_sensitive: true}
- {brand: sip, parent: Alder, type: shop, aliases: [sip of Alder Tea, sip], ambiguous_aliases: [sip]}
"""


def dictionary(s: SparkSession, d: str) -> DataFrame:
    rows = files.brands_frame(s, files.brands_of(DICTIONARY))
    return rows.select("brand", "parent", "type", F.array_join("aliases", "|").alias("aliases"), "case_sensitive", "ambiguous", F.array_join("ambiguous_aliases", "|").alias("ambiguous_aliases"))


def sheet(s: SparkSession, d: str) -> DataFrame:
    rows = [(r["n_nationkey"], r["n_name"] if r["n_nationkey"] % 4 else None, "a & <b>\r\n") for r in nations(s, d).orderBy("n_nationkey").collect()]  # as many as there are nations
    return files.read_sheet(s, BytesIO(files.sheet_bytes(["key", "name", "note"], rows)))


def written_regions(s: SparkSession, d: str) -> str:
    """A text file for each region."""
    path = new_path(s, "texts")
    B.read(s, d, "region").select("r_regionkey", "r_name").repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    return path


def whole_texts(s: SparkSession, d: str) -> DataFrame:
    return files.read_texts(s, written_regions(s, d)).select(F.regexp_extract("path", r"r_regionkey=(\d+)", 1).cast("long").alias("region"), "text")


def binary_files(s: SparkSession, d: str) -> DataFrame:
    return files.read_binary(s, written_regions(s, d)).select(F.col("body").cast("string").alias("body"), F.substring_index("suffix", ".", -1).alias("suffix"), (F.length("key") > 0).alias("keyed"))


def site_urls(s: SparkSession, d: str) -> DataFrame:
    return nations(s, d).select(F.format_string("https://h%d.example/p%d", "n_regionkey", "n_nationkey").alias("url"))


def crawl_cache(s: SparkSession, d: str) -> DataFrame:
    """The crawl cache after four batches of attempts, which are events of a user, with deltas merged on the way."""
    cache, none = CrawlCache(s, new_path(s, "crawl_cache"), fanout=3), F.lit("")
    events = B.read(s, d, "events").select("event_id", F.col("user_id").cast("string").alias("key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("fetched_at"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"))
    for n in range(4):
        batch = events.where(F.col("event_id") % 4 == n)
        cache.add(batch.select("key", F.col("key").alias("url"), F.col("key").alias("final_url"), "http_status", none.alias("fetch_error"), none.alias("content_type"), none.alias("encoding"), "fetched_at", F.col("event_id").cast("string").cast("binary").alias("body")), n)
    return cache.read().select(F.col("key").cast("long").alias("key"), F.col("body").cast("string").cast("long").alias("event_id"), (F.col("http_status") == 200).alias("good"))


def hosts(s: SparkSession, d: str) -> DataFrame:
    dealt = crawl.by_host(site_urls(s, d), 4).withColumn("part", F.spark_partition_id())
    return dealt.groupBy("host").agg(F.count("*").alias("urls"), F.countDistinct("part").alias("parts"))


def page_columns(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")
    written = F.when(k % 3 == 0, joined(" ", day, "T10:00")).when(k % 3 == 1, joined("on ", day)).otherwise(day)
    header = F.when(k % 4 == 0, F.col("p_size").cast("string")).when(k % 4 == 1, joined(" ", k.cast("string"), "00 ")).when(k % 4 == 2, "Mon, 31 Mar")
    body = pages.loaded_body(F.when(k % 2 == 0, F.col("p_name")), F.when(k % 5 > 0, F.col("p_brand")), k % 3 == 0)
    return B.read(s, d, "part").select(
        "p_partkey", pages.iso_date(written).alias("date"), pages.retry_wait(header).alias("wait"), body["body"].alias("body"), body["source"].alias("source"),
        pages.needs_render(F.when(k % 6 > 0, F.when(k % 6 == 1, 404).otherwise(200)), F.when(k % 2 == 0, "html").otherwise("pdf"), F.col("p_size"), 20).alias("render"),
    )


def markdown_answers(s: SparkSession, d: str) -> DataFrame:
    """A heading, wrapped lines, items, a table, an icon with its chip, links, escapes, a rule, a site's name and a bare number."""
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    lines = [
        joined("# Part ", k), text(""), joined("The **", name, "** weighs"), text("about 2.5 kg p.a. and"), text("is `cheap`. Is it? (It is!) See no. 7."), text(""), text("---"),
        joined("* [Size](https://x.example/", k, ") ", F.col("p_size").cast("string")), joined("2. *Type* ", F.col("p_type")), text("   goes on"), text("| Key | Brand |"), text("| :--- | ---: |"), joined("| ", k, " | ", F.col("p_brand"), " |"),
        text(""), joined("![](https://www.google.com/s2/favicons?domain=x", k, ".example)"), text(""), F.when(F.col("p_partkey") % 2 == 0, "A Site").otherwise("A long report on parts of all kinds"), text(""), F.when(F.col("p_partkey") % 3 == 0, "+3").otherwise("2\\_3"), text(""), text("parts.org"),
        text(""), joined("![pic](p.png)Last"), text("12."), text("line<br>end"),
    ]
    return B.read(s, d, "part").select(F.col("p_partkey").alias("answer_id"), F.concat_ws("\n", *lines).alias("answer_body"))


def jsonld_pages(s: SparkSession, d: str) -> DataFrame:
    """Structured data in its usual nestings, each block in as many graphs, two levels each, as its nation says."""
    k, day = F.col("n_nationkey"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey")), "yyyy-MM-dd")
    graph = joined('{"@graph": [{"@type": "NewsArticle", "datePublished": "', day, 'T01:02"}, {"@type": ["Corporation", "Thing"]}]}')
    block = F.when(k % 4 == 0, graph).when(k % 4 == 1, '{"@type": "FAQPage", "mainEntity": [{"@type": "Question"}, {"@type": "FAQPage"}]}')
    block = block.when(k % 4 == 2, '{"@type": broken').otherwise(joined('{"zeta": {"datePublished": "soon"}, "about": {"@type": "Report", "datePublished": " ', day, '"}, "alpha": {"datePublished": "2001-01-01"}}'))
    deep = F.aggregate(F.sequence(F.lit(1), k + 2), block, lambda acc, _: joined('{"@graph": [1, "[", ', acc, "]}"))
    html = joined("<html><head><title> ", F.col("n_name"), " &amp; co </title><meta property='article:published_time' content='2023-05-06T07:08'><script type='application/ld+json'>", deep, "</script></head><body><nav>Menu of words</nav><p>", F.repeat(F.lit("leaf "), k.cast("int")), "</p></body></html>")
    return nations(s, d).select(F.col("n_name").alias("url"), html.alias("html"))


def jsonld_fields(s: SparkSession, d: str) -> DataFrame:
    """Types and dates by VARIANT alone, titles and words by the reader of pages."""
    made = jsonld_pages(s, d)
    read = pages.extracted(made.select("url", F.lit("html").alias("content_kind"), F.lit("").alias("encoding"), F.col("html").cast("binary").alias("body"))).select("url", "title", "n_words")
    return jsonld.fields(made).join(read, "url").select("url", "title", "n_words", "published_date", "date_source", F.array_join("types", ";").alias("types"))


def date_sources(s: SparkSession, d: str) -> DataFrame:
    """Pages that say their date in every kind of place, through the reader of pages."""
    k, on = F.col("p_partkey"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    day, spelt, other = F.date_format(on, "yyyy-MM-dd"), F.date_format(on, "d MMMM yyyy"), F.lit("2011-11-11")
    place = k % 8
    head = F.when(place == 0, joined('<script type="application/ld+json">{"@type":"Article","datePublished":"', day, '"}</script>')).when(place == 1, joined('<meta property="article:published_time" content="', day, 'T08:00">'))
    head = head.when(place == 2, joined('<meta name="pubdate" content="', day, '"><meta property="og:updated_time" content="', other, '">')).otherwise("")
    body = F.when(place == 3, joined("<p>", other, "</p><time datetime='", day, "'>then</time>")).when(place == 4, joined("<p>On ", other, " tea was dear.</p><p>Published on ", spelt, "</p>"))
    body = body.when(place == 5, joined("<p>Of ", spelt, ", or of ", other, "</p>")).when(place == 6, joined("<time datetime='", other, "'>x</time><p>Posted: ", day, "</p>")).otherwise("<p>No day.</p>")
    url = joined("https://tea.example/", F.when((place == 6) | (place == 0), joined(F.date_format(on, "yyyy/MM/dd"), "/")).otherwise(""), k.cast("string"))
    html = joined("<html><head>", head, "</head><body>", body, "<p>Leaf &amp; bud</p></body></html>")
    rows = B.read(s, d, "part").select(url.alias("url"), F.lit("html").alias("content_kind"), F.lit("").alias("encoding"), html.cast("binary").alias("body"))
    return pages.extracted(rows).select("url", "published_date", "date_source", "n_words")


def pdf_pages(s: SparkSession, d: str) -> DataFrame:
    """A PDF of two pages for each region, one page of it in a deflated stream."""

    def made(name: str) -> bytes:
        import zlib

        parts = [b"<< /Type /Pages /Kids [2 0 R 3 0 R] /Count 2 >>", b"<< /Type /Page /Contents 4 0 R >>", b"<< /Type /Page /Contents 5 0 R >>", b"<< >> stream\nBT (Region %b) Tj ET\nendstream" % name.encode()]
        parts.append(b"<< /Filter /FlateDecode >> stream\n" + zlib.compress(b"BT (has \\(some\\)) Tj T* <4E6174696F6E73> Tj ET") + b"\nendstream")
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (k, o) for k, o in enumerate(parts, 1))

    rows = [(r["r_name"], "pdf", None, made(r["r_name"])) for r in B.read(s, d, "region").select("r_name").collect()]  # as many as there are regions
    found = pages.extracted(s.createDataFrame(rows, "url string, content_kind string, encoding string, body binary"))
    return found.select("url", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), "n_words", "n_pages", "error")


def page_table(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    day = lambda n: F.date_format(F.date_sub(F.lit("2025-03-31").cast("date"), n), "yyyy-MM-dd")
    source = F.when(k % 3 == 0, "jsonld").when(k % 3 == 1, "htmldate").otherwise("")
    parts = B.read(s, d, "part")
    meta = parts.select(
        k.alias("url"), k.alias("final_url"), F.when(k % 5 > 0, F.when(k % 5 == 1, 404).otherwise(200)).alias("http_status"), F.when(k % 5 == 0, "Timeout").alias("fetch_error"),
        F.lit("html").alias("content_kind"), F.lit("2025-03-31T08:00:00+00:00").alias("fetched_at"),
    )
    found = parts.where(k % 7 > 0).select(
        k.alias("url"), F.when(k % 13 == 0, "Page not found").otherwise(F.col("p_name")).alias("title"), (F.col("p_size") * 3).alias("n_words"), F.lit(None).cast("int").alias("n_pages"),
        F.when(source != "", day(F.col("p_size") % 9)).otherwise("").alias("published_date"), source.alias("date_source"), F.when(k % 11 == 0, "extract_error: X").otherwise("").alias("error"),
        F.when(k % 2 == 0, F.array(F.lit("Report"), F.lit("FAQPage"), F.lit("Report"))).otherwise(F.array(F.lit("Corporation"))).alias("schema_types"),
    )
    rows = pages.page_rows(meta, found, Config(run_date="2025-03-31"))
    return rows.select("url", "fetch_error", "is_readable", "soft_404", "n_words", "published_date", "date_source", "schema_types", "has_article_schema", "has_faq_schema", "has_org_schema", "title")


def answer_ids(s: SparkSession, d: str) -> DataFrame:
    raw = joined("a\r\nb", F.col("o_orderkey").cast("string"), "\rc\n")
    return B.read(s, d, "orders").select("o_orderkey", urls.answer_id(F.lower("o_orderstatus"), F.col("o_custkey")).alias("answer_id"), urls.newlines(raw).alias("raw"))


def unknown_numbers(s: SparkSession, d: str) -> DataFrame:
    shown = B.read(s, d, "part").select(F.format_string("%d of %d.5, or 1,000. In 7%%", "p_size", F.col("p_partkey") % 50).alias("text"))
    allowed = nations(s, d).select(F.explode(F.array(F.format_string("%d", "n_nationkey"), F.format_string("%d.5", "n_nationkey"))).alias("number"))
    return numbers.unknown_numbers(shown, allowed)


def wrapped_links(s: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    target = joined("https://www.n", k, ".example/p/?utm_source=x&a=", k)
    wrapped = joined("https://www.google.com/search?q=", F.url_encode(target))
    twice = joined("https://www.google.com/search?q=", F.url_encode(wrapped))
    first = F.when(F.col("n_nationkey") % 3 == 0, target).when(F.col("n_nationkey") % 3 == 1, wrapped).otherwise(twice)
    section = joined("- ", first, "\n- https://b.example then ", wrapped, "\nno link")
    return urls.wrapped_links(nations(s, d).select(F.col("n_nationkey").alias("answer_id"), section.alias("section")))


def deep_redirects(s: SparkSession, d: str) -> DataFrame:
    """Redirects in redirects, one deeper for each nation."""
    target = joined("https://www.n.example/p", F.col("n_nationkey").cast("string"))
    wrap = lambda u, _: joined("https://google.com/search?x=1&q=", F.replace(F.replace(F.replace(u, text("%"), text("%25")), text("&"), text("%26")), text("#"), text("%23")))
    deep = F.when(F.col("n_nationkey") > 0, F.aggregate(F.sequence(text(1), F.greatest(F.col("n_nationkey"), text(1))), target, wrap)).otherwise(target)
    return nations(s, d).select("n_nationkey", urls.normalize_url(deep).alias("url"))


def marked_hits(s: SparkSession, d: str) -> DataFrame:
    """Hits of the dictionary, and what was decided on ambiguous ones by the document's number."""
    return entities.all_hits(docs(s, d).select(F.col("doc_id").alias("answer_id"), F.lit(0).alias("sent_idx"), "text"), BRANDS)


def decisions(hits: DataFrame, upto: int) -> DataFrame:
    third = F.col("answer_id") % 3
    return hits.where(F.col("ambiguous") & (third <= upto)).select("answer_id", "sent_idx", F.col("alias_matched").alias("alias"), "char_pos", F.when(third == 0, "keep").otherwise("reject").alias("decision"))


def review_rows(s: SparkSession, d: str) -> DataFrame:
    hits = marked_hits(s, d)
    _, review = entities.decided(hits, decisions(hits, 1))
    return review.select("answer_id", "alias", "char_pos", F.length("sentence").alias("size"))


def reviewed_mentions(s: SparkSession, d: str) -> DataFrame:
    hits = marked_hits(s, d)
    return entities.gated(hits, decisions(hits, 2)).groupBy("brand", "alias_matched").agg(F.count("*").alias("n"), F.sum("char_pos").alias("positions"))


def ambiguous_by_decision(s: SparkSession, d: str) -> DataFrame:
    return quality.review_counts(decisions(marked_hits(s, d), 2))


def report_unreadable(s: SparkSession, d: str) -> DataFrame:
    pages_ = B.pages(s, d)
    return quality.table_lines(quality.unreadable_pages(pages_, B.CFG.readable_min_words), ["URL", "Reason"], [F.col("url")])


def markdown_rows(s: SparkSession, d: str) -> DataFrame:
    rows = [(r["r_regionkey"], None if r["r_regionkey"] == 2 else r["r_name"]) for r in B.read(s, d, "region").orderBy("r_regionkey").collect()]  # as many as there are regions
    return s.createDataFrame(list(enumerate(quality.markdown_table(["key", "name"], rows).split("\n"))), "place int, line string")


def grid_totals(s: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("content_kind") == "pdf", "raw").when(F.col("n_words") > 100, "rendered").otherwise("raw")
    return facts.grid_totals(B.answers(s, d), B.pages(s, d).withColumn("body_source", source))


def label_lookup(s: SparkSession, d: str) -> DataFrame:
    rates = brand.no_brand_rate(B.answers(s, d), B.mentions(s, d))
    return facts.lookup(rates, {"engine": "O", "intent": "BUILDING"}, "no_brand_rate")


SHAPES = {
    "csv_table": csv_table,
    "json_lines": json_lines,
    "dictionary": dictionary,
    "sheet": sheet,
    "whole_texts": whole_texts,
    "binary_files": binary_files,
    "crawl_cache": crawl_cache,
    "hosts": hosts,
    "page_columns": page_columns,
    "markdown_answers": lambda s, d: sentences.build_sentences(markdown_answers(s, d)),
    "jsonld_fields": jsonld_fields,
    "date_sources": date_sources,
    "pdf_pages": pdf_pages,
    "page_table": page_table,
    "answer_ids": answer_ids,
    "listed_names": lambda s, d: nations(s, d).groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names")).select("n_regionkey", numbers.listed(F.col("names")).alias("names"), numbers.listed(F.slice("names", 1, 1), "or").alias("first")),
    "unknown_numbers": unknown_numbers,
    "wrapped_links": wrapped_links,
    "deep_redirects": deep_redirects,
    "review_rows": review_rows,
    "reviewed_mentions": reviewed_mentions,
    "ambiguous_by_decision": ambiguous_by_decision,
    "report_unreadable": report_unreadable,
    "markdown_rows": markdown_rows,
    "grid_totals": grid_totals,
    "label_lookup": label_lookup,
}
