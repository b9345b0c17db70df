"""Named queries over the text tables: documents as answers, pages as cited pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import entities, numbers, pages, presentation, sentences, urls
from .functions.entities import Brand
from .operators import attribution as attribute
from .plans.bindings import read

#: A dictionary of words that the texts have: longer over shorter aliases, parents, case rules and an ambiguous alias.
BRANDS = [
    Brand("The", None, "a", ("the", "of the")),
    Brand("La", None, "b", ("la", "En la"), True, ("la",)),
    Brand("Und", "La", "c", ("und", "Und die"), True),
    Brand("Nicht", None, "c", ("Nicht",), True),
]


def docs(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", "text", "lang", "source")


def lines_of(text):
    return F.filter(F.split(text, "\n"), lambda x: sentences.strip(x) != "")


def split_docs(s: SparkSession, d: str) -> DataFrame:
    """Sentences of plain text: every line is a paragraph."""
    found = docs(s, d).select("doc_id", F.posexplode(F.flatten(F.transform(lines_of(F.col("text")), sentences.split_paragraph))).alias("sent_idx", "text"))
    return found.withColumn("n_words", sentences.word_count(F.col("text")))


def url_rows(s: SparkSession, d: str) -> DataFrame:
    url = urls.normalize_url(F.col("url"))
    return read(s, d, "pages").select("page_id", url.alias("clean"), urls.domain_of(F.col("url")).alias("domain"))


def hits(s: SparkSession, d: str) -> DataFrame:
    return entities.all_hits(docs(s, d).withColumn("sent_idx", F.lit(0)), BRANDS, keys=("doc_id", "sent_idx"))


def page_kinds(s: SparkSession, d: str) -> DataFrame:
    title = pages.html_title(F.col("html"))
    return read(s, d, "pages").select(
        "page_id", pages.cache_key(F.col("url")).alias("key"), title.alias("title"), pages.soft_404(title).alias("soft_404"),
        pages.content_kind(F.when(F.col("page_id") % 3 == 0, "text/html").when(F.col("page_id") % 3 == 1, "Application/PDF").otherwise(""), F.col("url")).alias("kind"),
        F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))).alias("links"),
    )


def extracted(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "pages").select("url", F.lit("html").alias("content_kind"), F.lit("utf-8").alias("encoding"), F.col("html").cast("binary").alias("body"))
    return pages.extracted(p).select("url", "title", "n_words", "date_source")


STOPWORDS = ("the", "and", "of", "der", "und", "la", "le", "de")


def attribution(s: SparkSession, d: str) -> DataFrame:
    """Documents as answers, each of which cites ten of all pages, in turn."""
    pages_ = read(s, d, "pages").select("page_id", "url", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    n = pages_.agg(F.count("*").alias("n_pages"))  # one row
    sentences_ = docs(s, d).select(F.col("doc_id").alias("answer_id"), F.posexplode(F.split("text", r"\. ")).alias("sent_idx", "text"))
    cited = docs(s, d).select(F.col("doc_id").alias("answer_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank")).join(F.broadcast(n))
    cited = cited.withColumn("page_id", (F.col("answer_id") * 3 + F.col("rank") * 7) % F.col("n_pages")).join(pages_.select("page_id", "url"), "page_id")
    texts = pages_.groupBy("url").agg(F.max("text").alias("text"))
    return attribute.attributed(sentences_, cited.select("answer_id", "rank", "url"), texts, stopwords=STOPWORDS)


TEXT = {
    "url_normalize": url_rows,
    "url_dedupe": lambda s, d: url_rows(s, d).groupBy("domain").agg(F.count("*").alias("pages"), F.countDistinct("clean").alias("urls")),
    "sentence_split": split_docs,
    "word_counts": lambda s, d: docs(s, d).select("doc_id", sentences.word_count(F.col("text")).alias("n_words")),
    "entity_mentions": lambda s, d: hits(s, d).groupBy("doc_id", "alias_matched").agg(F.count("*").alias("n"), F.sum("char_pos").alias("positions")),
    "entity_rollup": lambda s, d: hits(s, d).groupBy("brand", "sub_brand").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")),
    "entity_unambiguous": lambda s, d: entities.brand_counts(docs(s, d), BRANDS, key="doc_id"),
    "named_prompts": lambda s, d: docs(s, d).select("doc_id", entities.names_any(F.col("text"), BRANDS[3:]).alias("branded")),
    "page_kinds": page_kinds,
    "page_extract": extracted,
    "half_up": lambda s, d: read(s, d, "part").select("p_partkey", numbers.half_up(F.col("p_retailprice")).alias("price"), numbers.percent(F.col("p_size") / 1000, 1).alias("share")),
    "markdown_sentences": lambda s, d: sentences.build_sentences(docs(s, d).withColumnRenamed("text", "answer_body"), keys=("doc_id",)),
    "citation_sections": lambda s, d: urls.extract_citations(
        docs(s, d).select(F.col("doc_id").alias("answer_id"), F.col("source").alias("engine"), urls.citation_section(F.concat(F.col("text"), F.lit("\n## Links cited\n1. [a](https://www.A.example/p"), F.col("doc_id") % 3, F.lit("/?utm_x=1&q=2)\nhttps://a.example/p0?q=2 http://b.example/"), F.col("doc_id") % 2)).alias("section"))
    ),
    "title_contrast": lambda s, d: read(s, d, "nation").select("n_nationkey", presentation.contrast(F.format_string("#%02x%02x10", F.col("n_nationkey") * 10, 250 - F.col("n_nationkey") * 10), F.lit("#0B0C0E")).alias("contrast")),
    "line_counts": lambda s, d: docs(s, d).select("doc_id", presentation.line_count(F.col("text"), 40).alias("lines")),
    "attribution": attribution,
    "turns_by_role": lambda s, d: read(s, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(sentences.word_count(F.col("text"))).alias("words")),
}
