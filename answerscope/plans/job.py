"""The whole job: from a sheet of raw answers and a crawl to every table and the report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entities, pages, sentences, urls
from ..functions.entities import Brand, ReviewNeeded
from ..operators import quality
from ..sources.answers import load_answers, with_sections
from .compute import compute_all
from .config import Config
from .contracts import Watched, contract_rows, gather, hold, stored_watched
from .publish import Staged, StageStore
from .schemas import assert_counts


def queued(decisions: DataFrame, review: DataFrame) -> DataFrame:
    """The review queue: all decisions so far, and the hits that wait for one, each once."""
    keys = ["answer_id", "sent_idx", "alias", "char_pos"]
    fresh = review.dropDuplicates(keys).join(decisions, keys, "left_anti")
    return decisions.unionByName(fresh, allowMissingColumns=True)


def _kept(name: str, rows: DataFrame | Watched, checks: dict[str, int] | None) -> DataFrame:
    """The rows, stored; what the write observes goes to checks."""
    df, found = stored_watched(rows, name)
    gather({} if checks is None else checks, name, found)
    return df


def _as_expected(answers: DataFrame, cited: DataFrame, cfg: Config, checks: dict[str, int]) -> None:
    """Row counts, as the writes have observed them; only if these hold, distinct pages and sites, which take a job."""
    hold(checks, {k: n for k, n in cfg.expected_counts.items() if k in ("answers", "citations")})
    if cfg.expected_counts:
        assert_counts(answers, cited, cfg.expected_counts)


def read_answers(sheet: DataFrame, reruns: DataFrame | None, cfg: Config, checks: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """answers, citations and sentences; the counts are checked where the settings expect some. checks gets what is observed."""
    checks = {} if checks is None else checks
    answers = _kept("answers", with_sections(load_answers(sheet, reruns, cfg)), checks)
    cited = _kept("citations", urls.extract_citations(answers), checks)
    _as_expected(answers, cited, cfg, checks)
    return {"answers": answers, "citations": cited, "sentences": _kept("sentences", sentences.build_sentences(answers), checks)}


def _extracted(crawl: DataFrame, cfg: Config) -> DataFrame:
    return pages.extracted(crawl.select("url", "content_kind", "encoding", "body"), cfg.pdf_max_pages)


def _page_table(crawl: DataFrame, found: DataFrame, cfg: Config) -> Watched:
    """The pages; that a url has one row is observed, and the tables made of pages are guarded against more."""
    rows = pages.page_rows(crawl.drop("body", "encoding"), found, cfg)
    rendered = F.coalesce(F.col("rendered"), F.lit(False)) if "rendered" in crawl.columns else F.lit(False)
    source = crawl.select("url", F.when(rendered, "rendered").when(F.col("body").isNotNull(), "raw").otherwise("").alias("body_source"))
    pages_ = rows.join(source, "url").withColumn("of_url", F.count("*").over(Window.partitionBy("url")))
    return Watched(pages_, {"pages_of_repeated_urls": F.col("of_url") > 1}, None, ("of_url",))


def read_pages(crawl: DataFrame, brands: list[Brand], cfg: Config, checks: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """pages and page_brand_counts from a crawl (the columns of an attempt, content_kind, and rendered where there is any)."""
    found = _kept("extracted", _extracted(crawl, cfg), checks)
    return {"pages": _kept("pages", _page_table(crawl, found, cfg), checks), "page_brand_counts": _kept("page_brand_counts", entities.brand_counts(found.where("text <> ''"), brands), checks)}


def run_all(sheet: DataFrame, reruns: DataFrame | None, crawl: DataFrame, labels: dict[str, DataFrame], brands: list[Brand], cfg: Config, usual: int = 10) -> dict[str, DataFrame]:
    """Inputs, all metric tables and the report's lines. labels: domains, sentiment, ambiguous_hits, sentiment_spotcheck.

    Every input table is computed once and stored; what the writes observe of the contracts is the table `contracts`, and
    those that no table guards against end the job (ContractError) before it returns anything. Ambiguous hits that nobody has decided raise ReviewNeeded, whose rows
    are the queue with them added; write it, fill it in, and run again.
    """
    checks: dict[str, int] = {}
    t = labels | read_answers(sheet, reruns, cfg, checks)
    hits = _kept("hits", entities.all_hits(t["sentences"], brands), checks)
    mentions, review = entities.decided(hits, labels["ambiguous_hits"])
    if n := review.count():
        raise ReviewNeeded(queued(labels["ambiguous_hits"], review), n)
    t["mentions"] = _kept("mentions", mentions, checks)
    t |= read_pages(crawl, brands, cfg, checks)
    metrics = compute_all(t, cfg, checks)
    hold(checks)
    return t | metrics | {"report": quality.report_lines(t, cfg, usual), "contracts": contract_rows(sheet.sparkSession, checks)}


def published(store: StageStore, sources: dict[str, Staged], brands: list[Brand], cfg: Config, usual: int = 10) -> dict[str, DataFrame]:
    """The whole job in stages that a restart finds done, published at its end: sources are sheet, crawl and the labels
    (domains, sentiment, ambiguous_hits, sentiment_spotcheck), and reruns where there are any.

    Undecided ambiguous hits raise ReviewNeeded; stages up to there stay, and only what the decisions touch is done again.
    """
    said = repr((brands, cfg))
    checks: dict[str, int] = {}

    def stage(name: str, inputs: list[Staged], build: Callable[..., DataFrame | Watched], settings: str = said) -> Staged:
        made = store.stage(name, inputs, build, settings)
        gather(checks, name, made.observed)  # of a stage that was there already, what its own write observed
        return made

    reruns = [sources["reruns"]] if "reruns" in sources else []
    answers = stage("answers", [sources["sheet"], *reruns], lambda sheet, *r: with_sections(load_answers(sheet, *(r or [None]), cfg)))
    cited = stage("citations", [answers], urls.extract_citations)
    _as_expected(answers.df, cited.df, cfg, checks)
    t = {n: sources[n] for n in ("domains", "sentiment", "ambiguous_hits", "sentiment_spotcheck")} | {"answers": answers, "citations": cited}
    t["sentences"] = stage("sentences", [answers], sentences.build_sentences)
    hits = stage("hits", [t["sentences"]], lambda s: entities.all_hits(s, brands))
    _, review = entities.decided(hits.df, t["ambiguous_hits"].df)
    if n := review.count():
        raise ReviewNeeded(queued(t["ambiguous_hits"].df, review), n)
    t["mentions"] = stage("mentions", [hits, t["ambiguous_hits"]], lambda h, d: entities.decided(h, d)[0])
    found = stage("extracted", [sources["crawl"]], lambda c: _extracted(c, cfg))
    t["pages"] = stage("pages", [sources["crawl"], found], lambda c, f: _page_table(c, f, cfg))
    t["page_brand_counts"] = stage("page_brand_counts", [found], lambda f: entities.brand_counts(f.where("text <> ''"), brands))
    inputs = list(t.values())
    frames = lambda dfs: dict(zip(t, dfs, strict=True))
    names = ["brand_engine", "brand_pillar", "brand_intent", "no_brand_rate", "domains", "pages_top", "cross_engine_pages", "domain_type_mix", "authority_mix", "concentration", "source_sov", "readability", "recency", "schema", "vis", "vis_engine"]
    tables: dict[str, DataFrame] = {}

    def metric(name: str) -> Callable[..., DataFrame]:
        def build(*dfs: DataFrame) -> DataFrame:
            if not tables:  # what several tables share is computed once in a run, and only if one is missing
                seen: dict[str, int] = {}
                made = compute_all(frames(dfs), cfg, seen)
                hold(seen)  # a broken contract leaves no metric stage behind, so that a restart meets it again
                tables.update(made)
            return tables[name]

        return build

    out = {f"metric_{n}": stage(f"metric_{n}", inputs, metric(n)) for n in names}
    out["report"] = stage("report", inputs, lambda *dfs: quality.report_lines(frames(dfs), cfg, usual), f"{said}{usual}")
    store.publish(t | out)
    return store.read()
