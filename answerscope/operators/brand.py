"""Brand tables: mention rate, share of voice, position-weighted prominence, sentiment; and answers that name nobody.

Every cut comes from one table with a row for each (answer, brand) that occurs, which is stored, so mentions and
sentences are read and shuffled once, by answer, and all cuts are grouping sets over that table. The grid of every brand
for every existing group is filled with zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.contracts import Watched
from ..plans.storage import stored

LABELS = {"positive": "n_pos", "neutral": "n_neu", "negative": "n_neg", "mixed": "n_mixed"}


def pawc_weight(sent_idx, n_sents):
    return F.exp(-F.try_divide(sent_idx, n_sents))


def sentence_weights(sentences: DataFrame) -> DataFrame:
    """answer_id, sent_idx, n_sents, w: a sentence's share of the answer's words, discounted by its place."""
    whole = Window.partitionBy("answer_id")
    n = F.count("*").over(whole)
    return sentences.select(
        "answer_id", "sent_idx", n.alias("n_sents"),
        (F.try_divide(F.col("n_words"), F.sum("n_words").over(whole)) * pawc_weight(F.col("sent_idx"), n)).alias("w"),
    )


def answer_brands(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """answer_id, brand, ai_mentions, pawc, first_mention_pos for each pair that occurs."""
    return _pairs(sentences, mentions).drop("lost", "again")


def answer_brands_watched(sentences: DataFrame, mentions: DataFrame) -> Watched:
    """answer_brands with its contracts, counted in mentions: the sentence of a mention is there, and once."""
    breaks = {"mentions_without_sentence": F.col("lost"), "mentions_of_repeated_sentences": F.col("again")}
    return Watched(_pairs(sentences, mentions), breaks, None, ("lost", "again"))


def _pairs(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """The rows of answer_brands, with how many of a pair's mentions have no sentence, and how many have several.

    Sentences and mentions go through one exchange by answer, as rows of one table; what a mention needs of its
    sentence and of its answer are windows over that partitioning, and both groupings keep it.
    """
    rows = sentences.select("answer_id", "sent_idx", F.col("n_words").cast("double").alias("words"), F.lit(None).cast("string").alias("brand"), F.lit(1).alias("s"))
    rows = rows.unionByName(mentions.where(F.col("brand").isNotNull()).select("answer_id", "sent_idx", F.lit(None).cast("double").alias("words"), "brand", F.lit(0).alias("s")))
    whole, one = Window.partitionBy("answer_id"), Window.partitionBy("answer_id", "sent_idx")
    placed = rows.select(
        "*", F.sum("s").over(whole).alias("n_sents"), F.sum("words").over(whole).alias("all_words"), F.max("words").over(one).alias("own_words"),
        F.sum("s").over(one).alias("own_sents"),
    ).where("s = 0")
    each = placed.groupBy("answer_id", "brand", "sent_idx").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("n_sents", "all_words", "own_words", "own_sents")])
    so_many = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    weight = F.try_divide(F.col("own_words"), F.col("all_words")) * pawc_weight(F.col("sent_idx"), F.col("n_sents"))
    return each.groupBy("answer_id", "brand").agg(
        F.sum("n").alias("ai_mentions"), F.coalesce(F.sum(weight), F.lit(0.0)).alias("pawc"),
        F.try_divide(F.min("sent_idx"), F.max("n_sents")).alias("first_mention_pos"),
        so_many(F.col("own_sents") == 0).alias("lost"), so_many(F.col("own_sents") > 1).alias("again"),
    )


def brand_pawc(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    found = mentions.select("answer_id", "sent_idx", "brand").distinct()
    return found.join(sentence_weights(sentences), ["answer_id", "sent_idx"]).groupBy("answer_id", "brand").agg(F.sum("w").alias("pawc"))


def stored_facts(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """answer_brands, computed once."""
    return stored(answer_brands(sentences, mentions), "answer_brands")


def brand_table(answers: DataFrame, facts: DataFrame, sentiment: DataFrame, cut: str | None = None) -> DataFrame:
    """One row for each engine (and All), value of the cut, and brand that any answer of facts (stored_facts) names."""
    keys = ["engine", *([cut] if cut else [])]
    every = [F.coalesce(F.col("engine"), F.lit("All")).alias("engine"), *([F.col(cut)] if cut else [])]
    ids = answers.select("answer_id", *keys).where(F.col("engine").isNotNull())
    if cut:
        ids = ids.where(F.col(cut).isNotNull())
    sets = lambda *more: [[*keys, *more], [*keys[1:], *more]]
    flags = [F.count_if(F.col("label") == label).alias(name) for label, name in LABELS.items()]

    # every brand that exists in every group that exists: the rows of the result. Which side is sent around is left to Spark
    brands = facts.select("brand").distinct()
    facts = facts.join(ids, "answer_id")
    facts = facts.groupingSets([[F.col(c) for c in s] for s in sets("brand")], *[F.col(c) for c in (*keys, "brand")]).agg(
        F.count("*").alias("n_answers_mentioning"), F.sum("ai_mentions").alias("ai_mentions"), F.sum("pawc").alias("pawc_sum"), F.avg("first_mention_pos").alias("first_mention_pos")
    ).select(*every, "brand", "n_answers_mentioning", "ai_mentions", "pawc_sum", "first_mention_pos")
    felt = sentiment.select("answer_id", "brand", "label", "score").join(ids, "answer_id")
    felt = felt.groupingSets([[F.col(c) for c in s] for s in sets("brand")], *[F.col(c) for c in (*keys, "brand")]).agg(
        F.avg("score").alias("sentiment_mean"), *flags
    ).select(*every, "brand", "sentiment_mean", *LABELS.values())
    groups = ids.groupingSets([[F.col(c) for c in s] for s in sets()], *[F.col(c) for c in keys]).agg(F.count("*").alias("n")).select(*every, "n")
    grid = groups.crossJoin(brands)
    on = [*keys, "brand"]
    in_cut = Window.partitionBy(*keys)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return grid.join(facts, on, "left").join(felt, on, "left").select(
        *on, "n", zero("n_answers_mentioning").alias("n_answers_mentioning"),
        F.try_divide(zero("n_answers_mentioning"), F.col("n")).alias("mention_rate"),
        zero("ai_mentions").alias("ai_mentions"),
        F.coalesce(F.try_divide(zero("ai_mentions"), F.sum(zero("ai_mentions")).over(in_cut)), F.lit(0.0)).alias("ai_sov"),
        F.try_divide(F.coalesce(F.col("pawc_sum"), F.lit(0.0)), F.col("n")).alias("pawc"),
        "first_mention_pos", "sentiment_mean", *[zero(c).alias(c) for c in LABELS.values()],
    )


def no_brand_rate(answers: DataFrame, mentions: DataFrame) -> DataFrame:
    """Share of answers without any mention, for engine x intent with both totals."""
    named = mentions.select("answer_id").distinct().withColumn("named", F.lit(1.0))
    marked = answers.select("answer_id", "engine", "intent").join(named, "answer_id", "left")
    marked = marked.where(F.col("engine").isNotNull() & F.col("intent").isNotNull())
    return marked.cube("engine", "intent").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("named").isNull(), 1.0).otherwise(0.0)).alias("no_brand_rate")
    ).select(F.coalesce("engine", F.lit("All")).alias("engine"), F.coalesce("intent", F.lit("All")).alias("intent"), "n", "no_brand_rate")


def ai_sov_weighted(mentions: DataFrame) -> DataFrame:
    """brand, ai_sov_weighted: answers that name anyone count alike, and are shared out by mentions."""
    each = mentions.groupBy("answer_id", "brand").agg(F.count("*").alias("n"))
    shares = each.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("answer_id")))
    total = mentions.agg(F.countDistinct("answer_id").alias("answers"))  # one row
    return shares.groupBy("brand").agg(F.sum("share").alias("s")).join(F.broadcast(total)).select("brand", (F.col("s") / F.col("answers")).alias("ai_sov_weighted"))
