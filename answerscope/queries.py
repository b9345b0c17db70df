"""Named queries over the driver's tables: the metric tables, facts and shapes on the star binding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import brand, citation, facts, page, quality, reshape, score
from .plans import bindings as B
from .plans import contracts, schemas

ENGINES = B.CFG.engines
Query = Callable[[SparkSession, str], DataFrame]


def settled(df: DataFrame) -> DataFrame:
    """Doubles to 6 places and whole numbers as bigint, so that engines agree on the last digit."""
    kinds = {"double": lambda c: F.round(c, 6), "int": lambda c: F.col(c).cast("long"), "float": lambda c: F.round(F.col(c).cast("double"), 6)}
    return df.select(*[kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def cited(s: SparkSession, d: str) -> DataFrame:
    return citation.labelled(B.citations(s, d), B.answers(s, d), B.domains(s, d))


def brand_cut(cut: str | None) -> Query:
    return lambda s, d: brand.brand_table(B.answers(s, d), brand.stored_facts(B.sentences(s, d), B.mentions(s, d)), B.sentiment(s, d), cut)


def page_facts(s: SparkSession, d: str) -> DataFrame:
    return page.page_facts(B.pages(s, d), B.domains(s, d), B.CFG.run_date, B.CFG.recency_bins)


def vis(which: int) -> Query:
    """Sentences and mentions are gone through once, for all parts of the score."""

    def query(s: SparkSession, d: str) -> DataFrame:
        named = brand.stored_facts(B.sentences(s, d), B.mentions(s, d))
        table = brand.brand_table(B.answers(s, d), named, B.sentiment(s, d))
        return score.vis(B.answers(s, d), named, B.citations(s, d), B.domains(s, d), table, B.CFG)[which]

    return query


def repeated_pages(s: SparkSession, d: str) -> DataFrame:
    """Every fourth page stands in the table twice more, with fewer words, once unreadable."""
    pages = B.pages(s, d)
    some = pages.where(F.regexp_extract("url", r"p(\d+)$", 1).cast("int") % 4 == 0)
    worse = some.withColumns({"n_words": F.col("n_words") - 2, "is_readable": F.lit(False), "http_status": F.lit(404), "soft_404": F.lit(False), "published_date": F.lit(None).cast("date")})
    return pages.unionByName(worse).unionByName(some.withColumns({"n_words": F.col("n_words") - 1, "published_date": F.lit(None).cast("date"), "schema_types": F.lit("")}))


def guarded(s: SparkSession, d: str) -> DataFrame:
    return page.page_facts(repeated_pages(s, d), B.domains(s, d), B.CFG.run_date, B.CFG.recency_bins)


def broken_contracts(s: SparkSession, d: str) -> DataFrame:
    """What writing labelled citations and answers' brands observes where a part of the answers, sentences and labels is
    missing, and another stands twice."""
    answers, sentences, domains = B.answers(s, d).where("engine <> 'P'"), B.sentences(s, d).where("sent_idx <> 1"), B.domains(s, d)
    answers = answers.unionByName(answers.where("prompt_no % 10 = 0"))
    sentences = sentences.unionByName(sentences.where("sent_idx = 2"))
    domains = domains.where("domain_type <> 'EUROPE'").unionByName(domains.where("domain_type = 'ASIA'"))
    checks: dict[str, int] = {}
    contracts.gather(checks, "labelled", contracts.checked_only(citation.labelled_watched(B.citations(s, d), answers, domains)))
    contracts.gather(checks, "answer_brands", contracts.checked_only(brand.answer_brands_watched(sentences, B.mentions(s, d))))
    return contracts.contract_rows(s, checks)


def pillar_counts(s: SparkSession, d: str) -> DataFrame:
    """Prompts of one market segment count as branded here."""
    a = B.answers(s, d)
    return facts.pillar_counts(a, B.mentions(s, d), a.where("intent = 'MACHINERY'"))


def wrapped(s: SparkSession, d: str) -> DataFrame:
    """First citations count as wrapped here."""
    return B.citations(s, d).where("rank = 1")


def attempts(s: SparkSession, d: str) -> DataFrame:
    """Crawl attempts: events of a user are attempts at one page."""
    return B.read(s, d, "events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").alias("fetched_at"), (F.col("event_type") != "error").alias("good"))


STAR: dict[str, Query] = {
    "brand_engine": brand_cut(None),
    "brand_pillar": brand_cut("pillar"),
    "brand_intent": brand_cut("intent"),
    "sentence_weights": lambda s, d: brand.sentence_weights(B.sentences(s, d)),
    "brand_pawc": lambda s, d: brand.brand_pawc(B.sentences(s, d), B.mentions(s, d)),
    "answer_brands": lambda s, d: brand.answer_brands(B.sentences(s, d), B.mentions(s, d)),
    "no_brand_rate": lambda s, d: brand.no_brand_rate(B.answers(s, d), B.mentions(s, d)),
    "ai_sov_weighted": lambda s, d: brand.ai_sov_weighted(B.mentions(s, d)),
    "domains": lambda s, d: citation.domain_table(cited(s, d), B.pages(s, d), ENGINES),
    "pages_top": lambda s, d: citation.page_table(cited(s, d), ENGINES),
    "cross_engine_pages": lambda s, d: citation.cross_engine_pages(citation.page_table(cited(s, d), ENGINES), ENGINES),
    "domain_type_mix": lambda s, d: citation.mix(cited(s, d), "domain_type", by_pillar=True),
    "authority_mix": lambda s, d: citation.mix(cited(s, d), "authority_tier"),
    "concentration": lambda s, d: citation.concentration(cited(s, d)),
    "source_sov": lambda s, d: page.source_sov(B.mentions(s, d), B.pages(s, d), B.page_brand_counts(s, d)),
    "unreadable_reason": lambda s, d: page_facts(s, d).select("url", "domain", "reason", "group", "group_structured"),
    "readability": lambda s, d: page.readability(page_facts(s, d), B.citations(s, d)),
    "recency": lambda s, d: page.recency(page_facts(s, d), B.citations(s, d)),
    "recency_guarded": lambda s, d: page.recency(guarded(s, d), B.citations(s, d)),
    "readability_guarded": lambda s, d: page.readability(guarded(s, d), B.citations(s, d)),
    "pages_repeated": lambda s, d: page.repeated_pages(repeated_pages(s, d)),
    "schema": lambda s, d: page.schema_flags(page_facts(s, d)),
    "authority": lambda s, d: score.authority(B.answers(s, d), score.pairs_of(B.mentions(s, d)), B.citations(s, d), B.domains(s, d), B.CFG.authority_values),
    "vis": vis(0),
    "vis_engine": vis(1),
    "row_counts": lambda s, d: facts.row_counts(B.star(s, d)),
    "brands_by_engine": lambda s, d: facts.brands_by_engine(B.answers(s, d), B.mentions(s, d)),
    "leader_gap": lambda s, d: facts.leader_gap(brand_cut(None)(s, d)),
    "pillar_counts": pillar_counts,
    "pillar_leaders": lambda s, d: facts.pillar_leaders(pillar_counts(s, d)),
    "pillar_heatmap": lambda s, d: facts.pillar_heatmap(pillar_counts(s, d), ["Brand#1", "Brand#2", "Brand#3"]),
    "sentiment_counts": lambda s, d: facts.sentiment_counts(B.sentiment(s, d)),
    "intent_named_share": lambda s, d: facts.intent_named_share(brand.no_brand_rate(B.answers(s, d), B.mentions(s, d))),
    "source_mix": lambda s, d: facts.source_mix(citation.mix(cited(s, d), "domain_type", by_pillar=True)),
    "overlap_jaccard": lambda s, d: facts.overlap(B.citations(s, d), "F", "O"),
    "top_sites": lambda s, d: facts.top(citation.domain_table(cited(s, d), B.pages(s, d), ENGINES).select("domain", "domain_type", "citations", *ENGINES.values()), 12, F.desc("citations"), F.asc("domain")),
    "top_pages": lambda s, d: facts.top(citation.page_counts(cited(s, d), ENGINES).select("url", "domain", "citations", *ENGINES.values()), 8, F.desc("citations"), F.asc("url")),
    "top_page_by_domain": lambda s, d: facts.top_page_by_domain(citation.page_counts(cited(s, d), ENGINES)),
    "sov_gap_top": lambda s, d: facts.sov_gap_top(page.source_sov(B.mentions(s, d), B.pages(s, d), B.page_brand_counts(s, d))),
    "dead_links_2x2": lambda s, d: facts.dead_links(B.citations(s, d), B.pages(s, d), wrapped(s, d), "F"),
    "citations_per_answer": lambda s, d: facts.citations_per_answer(B.citations(s, d)),
    "mode_citations": lambda s, d: facts.modal_citations(B.citations(s, d)),
    "prompt_grid": lambda s, d: facts.prompt_grid(B.answers(s, d)),
    "dated_citations": lambda s, d: facts.dated(page.recency(page_facts(s, d), B.citations(s, d))),
    "compare_prompt": lambda s, d: facts.compare_prompt(B.answers(s, d), B.mentions(s, d), 13),
    "expected_counts": lambda s, d: schemas.counts(B.answers(s, d), B.citations(s, d)),
    "contracts_observed": broken_contracts,
    "mentions_without_answer": lambda s, d: schemas.subset(B.mentions(s, d), B.answers(s, d).where("engine <> 'P'"), ["answer_id"]),
    "override_by_key": lambda s, d: reshape.override(B.answers(s, d).select("answer_id", "prompt_no", "pillar"), B.answers(s, d).where("pillar = '5-LOW'").select("answer_id", F.lit("changed").alias("pillar")), ["answer_id"], "pillar"),
    "unpivot_engines": lambda s, d: reshape.unpivot_engines(B.read(s, d, "customer").select("c_custkey", F.col("c_name").alias("F"), F.col("c_mktsegment").alias("O")), ["c_custkey"], ["F", "O"], "text"),
    "wrapped_mark": lambda s, d: reshape.mark(B.citations(s, d).select("answer_id", "rank", "url"), wrapped(s, d), ["answer_id", "url"], "wrapped"),
    "cache_merge_newest_good": lambda s, d: reshape.newest_good(attempts(s, d), "key", F.col("good"), "fetched_at").select("key", "event_id", "good"),
    "rate_maps": lambda s, d: facts.rate_maps(brand_cut(None)(s, d)).select("brand", facts.written_map(F.col("n_answers_mentioning")).alias("answers")),
    "exclusive_brands": lambda s, d: facts.exclusive_brands(B.answers(s, d), B.mentions(s, d).join(B.answers(s, d).select("answer_id", "prompt_no"), "answer_id").select("answer_id", F.concat_ws("/", "brand", "prompt_no").alias("brand"))),
    "top_brands": lambda s, d: facts.top_brands(brand_cut(None)(s, d), 5),
    "domain_focus": lambda s, d: facts.domain_focus(B.citations(s, d), ["d1.example", "d39.example", "none.example"], "O"),
    "share_sum": lambda s, d: facts.share_sum(citation.mix(cited(s, d), "domain_type", by_pillar=True), ["ASIA", "EUROPE"]),
    "schema_by_type": lambda s, d: facts.schema_by_type(page.schema_flags(page_facts(s, d))),
    "crawl_outcomes": lambda s, d: quality.crawl_outcomes(B.pages(s, d), B.CFG.readable_min_words),
    "readable_shares": lambda s, d: quality.readable_shares(B.pages(s, d), B.citations(s, d)),
    "odd_citations": lambda s, d: facts.citations_per_answer(B.citations(s, d), 4),
    "pillars_in_order": lambda s, d: reshape.in_order(B.answers(s, d).where("engine = 'F'").groupBy("pillar").agg(F.count("*").alias("n")), "pillar", ["5-LOW", "1-URGENT", "9-NONE"], {"n": 0}),
    "repeated_citations": lambda s, d: schemas.repeated(B.citations(s, d), ["answer_id", "domain"]),
    "incremental_anti": lambda s, d: reshape.unfetched(B.read(s, d, "customer").select(F.col("c_custkey").alias("key")), attempts(s, d), "key", F.col("good")),
}


def queries() -> dict[str, Query]:
    from .shape_queries import SHAPES
    from .text_queries import TEXT

    return {name: (lambda s, d, f=f: settled(f(s, d))) for name, f in (STAR | TEXT | SHAPES).items()}
