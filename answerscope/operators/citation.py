"""Citation tables: domains, pages, source mixes and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.contracts import Watched
from ..plans.storage import stored

#: Ways that rows without a key are dealt.
KEYLESS = 64


def labelled(citations: DataFrame, answers: DataFrame, domains: DataFrame) -> DataFrame:
    """Citations with the answer's prompt and pillar, and the domain's labels where it has any."""
    c = citations.select("answer_id", "engine", "rank", "url", "domain").join(answers.select("answer_id", "prompt_no", "pillar"), "answer_id")
    return c.join(domains.select("domain", "domain_type", "authority_tier"), "domain", "left")


def labelled_watched(citations: DataFrame, answers: DataFrame, domains: DataFrame) -> Watched:
    """labelled, with its contracts: each answer once, each citation of an answer there is; domains labelled, and once.

    Citations and answers go through one exchange by answer as rows of one table, so that answers without citations are
    seen too. A repeated answer or label multiplies nothing: the largest of its rows counts. Rows without answer_id are
    dealt by their url.
    """
    labels = domains.groupBy("domain").agg(F.max(F.struct("domain_type", "authority_tier")).alias("label"), F.count("*").alias("n_labels"))
    c = citations.select("answer_id", "engine", "rank", "url", "domain").join(labels, "domain", "left")
    rows = c.withColumn("is_answer", F.lit(False)).unionByName(
        answers.select("answer_id", F.struct("prompt_no", "pillar").alias("answer"), F.lit(True).alias("is_answer")), allowMissingColumns=True
    )
    whole = Window.partitionBy("answer_id", F.when(F.col("answer_id").isNull(), F.pmod(F.xxhash64("url"), F.lit(KEYLESS))))
    rows = rows.withColumns({"n_answers": F.count_if("is_answer").over(whole), "answer": F.max("answer").over(whole)})
    known = F.col("answer_id").isNotNull() & (F.col("n_answers") > 0)
    cited = ~F.col("is_answer")
    placed = rows.select(
        "domain", "answer_id", "engine", "rank", "url", "answer.prompt_no", "answer.pillar", "label.domain_type", "label.authority_tier", "is_answer", "n_answers", "n_labels"
    )
    breaks = {
        "answers_repeated": F.col("is_answer") & F.col("answer_id").isNotNull() & (F.col("n_answers") > 1), "answers_without_id": F.col("is_answer") & F.col("answer_id").isNull(),
        "citations_without_answer": cited & ~known, "citations_unlabelled": cited & F.col("n_labels").isNull(), "citations_of_repeated_labels": cited & (F.col("n_labels") > 1),
    }
    return Watched(placed, breaks, cited & known, ("is_answer", "n_answers", "n_labels"))


def readable_urls(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("is_readable").cast("string") == "true").select("url").distinct()


def domain_table(cited: DataFrame, pages: DataFrame, engines: dict[str, str]) -> DataFrame:
    """Labelled domains with totals and each engine's counts; n counts unlabelled ones too.

    Distinct pages, prompts and answers are three groupings that each combine before their exchange; several distinct
    counts in one aggregate would send every citation once for each of them. What they read is stored once.
    """
    cited = stored(cited.select("domain", "domain_type", "authority_tier", "engine", "rank", "url", "prompt_no", "answer_id"), "cited")
    keys = ["domain", "domain_type", "authority_tier"]
    labelled_ = cited.where(F.col("domain_type").isNotNull() & F.col("authority_tier").isNotNull() & F.col("domain").isNotNull())
    own = [x for e, c in engines.items() for x in (F.count_if(F.col("engine") == e).alias(f"n_{c}"), F.sum(F.when(F.col("engine") == e, F.col("rank"))).alias(f"r_{c}"))]
    by_page = labelled_.groupBy(*keys, "url").agg(F.count("url").alias("k"), F.count("rank").alias("ranked"), F.sum("rank").alias("r"), *own)
    by_page = by_page.join(readable_urls(pages).withColumn("ok", F.lit(True)), "url", "left")
    sums = by_page.groupBy(*keys).agg(
        F.sum("k").alias("citations"), F.count("url").alias("unique_pages"), F.try_divide(F.sum("r"), F.sum("ranked")).alias("avg_rank"),
        *[x for c in engines.values() for x in (
            F.sum(f"n_{c}").alias(c), F.try_divide(F.sum(f"r_{c}"), F.sum(f"n_{c}")).alias(f"avg_rank_{c}"),
            F.count_if((F.col(f"n_{c}") > 0) & F.coalesce("ok", F.lit(False))).alias(f"readable_pages_{c}"),
        )],
    )
    distinct = lambda c, out: labelled_.select("domain", c).distinct().groupBy("domain").agg(F.count(c).alias(out))
    total = cited.agg(F.count("*").alias("n"))  # one row
    return sums.join(distinct("prompt_no", "prompts"), "domain").join(distinct("answer_id", "answers"), "domain").join(F.broadcast(total))


def page_counts(citations: DataFrame, engines: dict[str, str]) -> DataFrame:
    """A row for each page: citations in all and by engine, and who cites it."""
    each = citations.groupBy("url", "domain").agg(
        F.count("answer_id").alias("citations"), *[F.count_if(F.col("engine") == e).alias(c) for e, c in engines.items()],
        F.array_join(F.sort_array(F.collect_set("engine")), "+").alias("engines"),
    )
    total = citations.agg(F.count("*").alias("n"))  # one row
    return each.join(F.broadcast(total))


def page_table(citations: DataFrame, engines: dict[str, str]) -> DataFrame:
    """Pages ranked by citations and then by url."""
    return ranked(page_counts(citations, engines), [F.desc("citations"), F.asc("url")])


def ranked(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """1-based place of every row in one order, without bringing all rows to one task.

    Rows are range-partitioned in that order and stored once (this runs a job), since a second run may draw other
    ranges; the few partition totals then give each partition its first place.
    """
    parts = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__rows"))  # a row for each partition
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")
    return parts.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn(out, place).drop("__part", "__before")


def cross_engine_pages(pages_top: DataFrame, engines: dict[str, str]) -> DataFrame:
    return pages_top.where(F.col("engines") == "+".join(sorted(engines)))


def mix(cited: DataFrame, col: str, by_pillar: bool = False) -> DataFrame:
    """Citations by value of col for each engine (and pillar) with totals; shares are of all citations of the group."""
    keys = ["engine", *(["pillar"] if by_pillar else [])]
    if by_pillar:
        cited = cited.where(F.col("pillar").isNotNull())
    counts = cited.groupBy(*keys, col).agg(F.count("*").alias("c"))  # small from here on
    cubed = counts.cube(*keys, col).agg(F.sum("c").alias("citations"), F.grouping(col).alias("__all"), F.sum(F.when(F.col(col).isNull(), F.col("c"))).alias("__null"))
    named = [F.coalesce(F.col(k), F.lit("All")).alias(k) for k in keys]
    total = cubed.where("__all = 1").select(*named, F.col("citations").alias("n"))
    rows = cubed.where((F.col("__all") == 0) & F.col(col).isNotNull()).select(*named, col, "citations")
    return rows.join(total, keys).select(*keys, col, "citations", (F.col("citations") / F.col("n")).alias("share"), "n")


def concentration(cited: DataFrame, top: int = 5) -> DataFrame:
    """The share of the most cited domains for each engine and All."""
    counts = cited.groupBy("engine", "domain").agg(F.count("*").alias("c"))
    both = counts.groupingSets([[F.col("engine"), F.col("domain")], [F.col("domain")]], F.col("engine"), F.col("domain")).agg(F.sum("c").alias("c"))
    both = both.select(F.coalesce("engine", F.lit("All")).alias("engine"), "domain", "c")
    order = Window.partitionBy("engine").orderBy(F.desc("c"), F.asc_nulls_last("domain"))
    best = both.where(F.col("domain").isNotNull()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    n = both.groupBy("engine").agg(F.sum("c").alias("n"))
    return best.groupBy("engine").agg(F.sum("c").alias("s")).join(n, "engine").select("engine", (F.col("s") / F.col("n")).alias("top5_share"), "n")
