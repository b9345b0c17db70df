"""The tables' schemas and the contracts that are checked before metrics are computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: DDL, since a session is needed to parse it.
SCHEMAS = {
    "answers": "answer_id string, engine string, prompt_no int, pillar string, intent string, prompt string, answer_raw string, run_date date, answer_body string",
    "citations": "answer_id string, engine string, rank int, url_raw string, url string, domain string",
    "sentences": "answer_id string, sent_idx int, text string, n_words int",
    "mentions": "answer_id string, sent_idx int, brand string, sub_brand string, alias_matched string, char_pos int",
    "brands": "brand string, parent string, type string, aliases array<string>, case_sensitive boolean, ambiguous boolean, ambiguous_aliases array<string>",
    "ambiguous_hits": "answer_id string, sent_idx int, alias string, char_pos int, sentence string, decision string, note string",
    "sentiment": "answer_id string, brand string, label string, score int, evidence string, reason string",
    "sentiment_spotcheck": "answer_id string, result string, note string",
    "domains": "domain string, domain_type string, authority_tier string, note string",
    "pages": "url string, final_url string, http_status int, fetch_error string, content_kind string, is_readable boolean, soft_404 boolean, title string, n_words int, n_pages int, published_date date, date_source string, schema_types string, has_article_schema boolean, has_faq_schema boolean, has_org_schema boolean, crawled_at timestamp, body_source string",
    "page_brand_counts": "url string, brand string, count int, first_pos_ratio double",
    "crawl_meta": "key string, url string, final_url string, http_status int, fetch_error string, content_type string, content_kind string, encoding string, fetched_at string, rendered boolean",
}


class ContractError(AssertionError):
    """Data that break a contract."""


def has_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")


def subset(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of left that right lacks: empty if the contract holds."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")


def repeated(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that more than one row has: empty if they are unique."""
    return df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def counts(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: answers, citations, unique_urls, domains."""
    of_citations = citations.agg(F.count("*").alias("citations"), F.countDistinct("url").alias("unique_urls"), F.countDistinct("domain").alias("domains"))
    return answers.agg(F.count("*").alias("answers")).join(F.broadcast(of_citations))  # one row each


def assert_counts(answers: DataFrame, citations: DataFrame, expected: dict[str, int]) -> dict[str, int]:
    actual = counts(answers, citations).first().asDict()
    if actual != expected:
        raise ContractError(f"expected {expected}, got {actual}")
    return actual
