"""Fact queries over inputs and metric tables: what a report or a slide shows, each as a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(item, n): rows of the tables, readable pages, and readable pages that name a brand."""
    readable = tables["pages"].where(F.col("is_readable").cast("string") == "true")
    named = tables["page_brand_counts"].join(readable.select("url").distinct(), "url", "left_semi")
    parts = [tables[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("item"), "n") for t in ("answers", "sentences", "mentions", "citations", "pages")]
    parts += [readable.agg(F.count("*").alias("n")).select(F.lit("readable_pages").alias("item"), "n"), named.agg(F.countDistinct("url").alias("n")).select(F.lit("readable_pages_with_brand").alias("item"), "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brands_by_engine(answers: DataFrame, mentions: DataFrame) -> DataFrame:
    return mentions.select("answer_id", "brand").join(answers.select("answer_id", "engine"), "answer_id").groupBy("engine").agg(F.countDistinct("brand").alias("brands"))


def rate_maps(brand_engine: DataFrame) -> DataFrame:
    """brand -> rates and answers by engine, as maps over the engines that name it."""
    named = brand_engine.where("n_answers_mentioning > 0")
    entries = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("engine", c)))).alias(c)
    return named.groupBy("brand").agg(entries("mention_rate"), entries("n_answers_mentioning"))


def pillar_counts(answers: DataFrame, mentions: DataFrame, excluded_prompts: DataFrame | None = None) -> DataFrame:
    """pillar, brand, n, named, mention_rate over answers whose prompt is not excluded."""
    a = answers.select("answer_id", "prompt_no", "pillar")
    if excluded_prompts is not None:
        a = a.join(excluded_prompts.select("prompt_no").distinct(), "prompt_no", "left_anti")
    n = a.groupBy("pillar").agg(F.count("*").alias("n"))
    named = mentions.select("answer_id", "brand").distinct().join(a, "answer_id").groupBy("pillar", "brand").agg(F.count("*").alias("named"))
    return named.join(n, "pillar").select("pillar", "brand", "n", "named", (F.col("named") / F.col("n")).alias("mention_rate"))


def pillar_leaders(counts: DataFrame) -> DataFrame:
    """All brands that share the first place of a pillar."""
    first = counts.withColumn("r", F.rank().over(Window.partitionBy("pillar").orderBy(F.desc("named")))).where("r = 1")
    return first.groupBy("pillar").agg(F.array_join(F.sort_array(F.collect_list("brand")), "+").alias("leaders"), F.max("named").alias("named"))


def pillar_heatmap(counts: DataFrame, brands: list[str]) -> DataFrame:
    """pillar x brand rates, absent ones 0."""
    wide = counts.groupBy("pillar").pivot("brand", brands).agg(F.max("mention_rate"))
    return wide.na.fill(0.0, brands)


def leader_gap(brand_engine: DataFrame) -> DataFrame:
    """Each brand's distance to its engine's leader, and the place by mention rate."""
    w = Window.partitionBy("engine")
    place = F.dense_rank().over(w.orderBy(F.desc("mention_rate")))
    return brand_engine.select("engine", "brand", "mention_rate", place.alias("place"), (F.max("mention_rate").over(w) - F.col("mention_rate")).alias("gap"))


def sentiment_counts(sentiment: DataFrame) -> DataFrame:
    labels = ("positive", "neutral", "mixed", "negative")
    return sentiment.agg(*[F.count_if(F.col("label") == x).alias(x) for x in labels], F.count("*").alias("pairs"))


def intent_named_share(no_brand: DataFrame) -> DataFrame:
    return no_brand.where("engine = 'All' and intent <> 'All'").select("intent", (1 - F.col("no_brand_rate")).alias("named_share"), "n")


def source_mix(type_mix: DataFrame) -> DataFrame:
    """engine -> shares and citations by domain type, as sorted text pairs."""
    by = type_mix.where("pillar = 'All' and engine <> 'All'")
    return by.groupBy("engine").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "domain_type", "citations"))), ",").alias("counts"), F.sum("share").alias("labelled_share"))


def overlap(citations: DataFrame, first: str, second: str) -> DataFrame:
    """Sites and pages that two engines share, in one pass each, with Jaccard indices."""
    out = None
    for key, name in (("domain", "sites"), ("url", "pages")):
        sides = citations.groupBy(key).agg(F.max(F.col("engine") == first).alias("a"), F.max(F.col("engine") == second).alias("b"))
        one = sides.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("first_only"), F.count_if(~F.col("a") & F.col("b")).alias("second_only"))
        total = F.col("both") + F.col("first_only") + F.col("second_only")
        one = one.select(F.lit(name).alias("what"), "both", "first_only", "second_only", total.alias("total"), F.try_divide(F.col("both"), total).alias("jaccard"))
        out = one if out is None else out.unionByName(one)
    return out


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sov_gap_top(source_sov: DataFrame, k: int = 8) -> DataFrame:
    named = source_sov.where("ai_mentions > 0").select("brand", "ai_sov_weighted", "source_sov", "sov_gap")
    return top(named, k, F.desc_nulls_last("ai_sov_weighted"), F.asc("brand"))


def top_page_by_domain(pages_top: DataFrame) -> DataFrame:
    w = Window.partitionBy("domain").orderBy(F.desc("citations"), F.asc("url"))
    return pages_top.withColumn("r", F.row_number().over(w)).where("r = 1").select("domain", "url", "citations")


def dead_urls(pages: DataFrame) -> DataFrame:
    soft = F.lower(F.col("soft_404").cast("string")) == "true" if "soft_404" in pages.columns else F.lit(False)
    return pages.where(F.col("http_status").cast("string").startswith("404") | soft).select("url").distinct()


def dead_links(citations: DataFrame, pages: DataFrame, wrapped: DataFrame, engine: str) -> DataFrame:
    """Dead and all citations of one engine, by whether the link was wrapped by a search redirect.

    wrapped: (answer_id, url).
    """
    own = citations.where(F.col("engine") == engine).select("answer_id", "url")
    own = own.join(wrapped.select("answer_id", "url").distinct().withColumn("w", F.lit(True)), ["answer_id", "url"], "left")
    own = own.join(dead_urls(pages).withColumn("d", F.lit(True)), "url", "left")
    w, d = F.coalesce("w", F.lit(False)), F.coalesce("d", F.lit(False))
    return own.agg(F.count_if(w & d).alias("wrapped_dead"), F.count_if(w).alias("wrapped"), F.count_if(~w & d).alias("direct_dead"), F.count_if(~w).alias("direct"))


def citations_per_answer(citations: DataFrame, expected: int | None = None) -> DataFrame:
    """Answers by number of citations; with expected, only the answers that have another number."""
    each = citations.groupBy("answer_id").agg(F.count("*").alias("n"))
    return each.groupBy("n").agg(F.count("*").alias("answers")) if expected is None else each.where(F.col("n") != expected)


def modal_citations(citations: DataFrame) -> DataFrame:
    """The most common number of citations; the smallest of several."""
    return citations_per_answer(citations).orderBy(F.desc("answers"), F.asc("n")).limit(1).select(F.col("n").alias("mode"))


def exclusive_brands(answers: DataFrame, mentions: DataFrame) -> DataFrame:
    """Brands that one engine alone names."""
    by = mentions.select("answer_id", "brand").join(answers.select("answer_id", "engine"), "answer_id").groupBy("brand").agg(F.collect_set("engine").alias("e"))
    return by.where(F.size("e") == 1).select("brand", F.element_at("e", 1).alias("engine"))


def prompt_grid(answers: DataFrame) -> DataFrame:
    return answers.groupBy("pillar", "intent").agg(F.countDistinct("prompt_no").alias("prompts"), F.count("*").alias("answers"))


def grid_totals(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: distinct prompts, pillars and intents, and the pages that were read as a browser rendered them."""
    rendered = pages.agg(F.count_if(F.col("body_source") == "rendered").alias("rendered_pages"))
    return answers.agg(*[F.countDistinct(c).alias(name) for c, name in (("prompt_no", "prompts"), ("pillar", "pillars"), ("intent", "intents"))]).crossJoin(rendered)  # one row each


def lookup(df: DataFrame, wanted: dict[str, str], column: str) -> DataFrame:
    """(column) of the row with the wanted labels; more than one such row is an error, none a null."""
    rows = df
    for name, label in wanted.items():
        rows = rows.where(F.col(name) == label)
    return rows.agg(F.when(F.count("*") > 1, F.raise_error(F.lit(f"{wanted} is not one row"))).otherwise(F.first(column)).alias(column))


def dated(recency: DataFrame) -> DataFrame:
    """Readable citations, and those with a structured date."""
    r = recency.where("cut = 'engine' and value = 'All' and basis = 'structured dates only'")
    return r.agg(F.max("n").alias("readable_citations"), F.sum(F.when(F.col("group") != "unknown", F.col("citations"))).alias("dated_citations"))


def compare_prompt(answers: DataFrame, mentions: DataFrame, prompt_no: int) -> DataFrame:
    """Brands each engine names for one prompt."""
    a = answers.where(F.col("prompt_no") == prompt_no).select("answer_id", "engine")
    return mentions.select("answer_id", "brand").join(a, "answer_id").groupBy("engine").agg(F.array_join(F.sort_array(F.collect_set("brand")), "+").alias("brands"))


def top_brands(brand_engine: DataFrame, k: int = 10) -> DataFrame:
    """The k brands with the highest mention rate in each engine; names settle ties."""
    w = Window.partitionBy("engine").orderBy(F.desc_nulls_last("mention_rate"), F.asc("brand"))
    return brand_engine.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("engine", "place", "brand", "mention_rate")


def domain_focus(citations: DataFrame, domains: list[str], engine: str) -> DataFrame:
    """Citations and citing answers of chosen domains in one engine, absent ones 0."""
    order = citations.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
    own = citations.where((F.col("engine") == engine) & F.col("domain").isin(domains)).groupBy("domain").agg(F.count("*").alias("citations"), F.countDistinct("answer_id").alias("answers"))
    return order.join(own, "domain", "left").na.fill(0)


def share_sum(type_mix: DataFrame, types: list[str]) -> DataFrame:
    """engine -> the share of several domain types together."""
    return type_mix.where((F.col("pillar") == "All") & F.col("domain_type").isin(types)).groupBy("engine").agg(F.sum("share").alias("share"))


def schema_by_type(schema: DataFrame) -> DataFrame:
    return schema.where("domain_type <> 'All'").select("domain_type", "n", "any_jsonld")


def written_map(m: Column) -> Column:
    """A map as text, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat_ws("=", k, F.element_at(m, k).cast("string"))), ",")
