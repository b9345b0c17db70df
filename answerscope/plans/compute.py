"""All metric tables from all inputs: the entry point for embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import brand, citation, page, score
from .config import Config
from .contracts import gather, stored_watched


def compute_all(tables: dict[str, DataFrame], cfg: Config | None = None, checks: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Lazily, but for what several results need (answers' brands, labelled citations) and the pages' ranks: these are stored.

    checks, where it is given, gets what these writes observe: rows, and breaks of each contract (contracts.hold).
    """
    cfg = cfg or Config()
    checks = {} if checks is None else checks
    t = tables
    answers, mentions, citations = t["answers"], t["mentions"], t["citations"]
    named, found = stored_watched(brand.answer_brands_watched(t["sentences"], mentions), "answer_brands")
    gather(checks, "answer_brands", found)
    parts = answers, named, t["sentiment"]
    out = {"brand_engine": brand.brand_table(*parts), "brand_pillar": brand.brand_table(*parts, cut="pillar"), "brand_intent": brand.brand_table(*parts, cut="intent")}
    out["no_brand_rate"] = brand.no_brand_rate(answers, mentions)
    cited, found = stored_watched(citation.labelled_watched(citations, answers, t["domains"]), "labelled")
    gather(checks, "labelled", found)
    out["domains"] = citation.domain_table(cited, t["pages"], cfg.engines)
    # as in the citation tables, only citations of known answers count
    out["pages_top"] = citation.page_table(cited, cfg.engines)
    out["cross_engine_pages"] = citation.cross_engine_pages(out["pages_top"], cfg.engines)
    out["domain_type_mix"] = citation.mix(cited, "domain_type", by_pillar=True)
    out["authority_mix"] = citation.mix(cited, "authority_tier")
    out["concentration"] = citation.concentration(cited)
    out["source_sov"] = page.source_sov(mentions, t["pages"], t["page_brand_counts"])
    facts = page.page_facts(t["pages"], t["domains"], cfg.run_date, cfg.recency_bins)
    out["readability"] = page.readability(facts, citations)
    out["recency"] = page.recency(facts, citations)
    out["schema"] = page.schema_flags(facts)
    out["vis"], out["vis_engine"] = score.vis(answers, named, citations, t["domains"], out["brand_engine"], cfg)
    return out
