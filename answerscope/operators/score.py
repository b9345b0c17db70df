"""The composite visibility score."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import Config


def pairs_of(mentions: DataFrame) -> DataFrame:
    """Each (answer, brand) that occurs, once."""
    return mentions.select("answer_id", "brand").distinct()


def authority(answers: DataFrame, pairs: DataFrame, citations: DataFrame, domains: DataFrame, values: dict[str, float]) -> DataFrame:
    """engine (and All), brand, authority: mean tier value over the citations of the answers that name the brand.

    pairs: each (answer, brand) once, as brand.answer_brands has them. The citations of an answer are summed before they
    meet its brands.
    """
    score = F.create_map(*[F.lit(x) for x in chain(*values.items())])
    rated = citations.select("answer_id", "domain").join(domains.select("domain", score[F.col("authority_tier")].alias("v")), "domain")
    sums = rated.groupBy("answer_id").agg(F.sum("v").alias("s"), F.count("v").alias("k"))
    joined = pairs.select("answer_id", "brand").join(answers.select("answer_id", "engine"), "answer_id").join(sums, "answer_id", "left")
    rolled = joined.groupingSets([[F.col("engine"), F.col("brand")], [F.col("brand")]], F.col("engine"), F.col("brand")).agg(
        F.try_divide(F.sum("s"), F.sum("k")).alias("authority")
    )
    return rolled.select(F.coalesce("engine", F.lit("All")).alias("engine"), "brand", "authority")


def vis(answers: DataFrame, pairs: DataFrame, citations: DataFrame, domains: DataFrame, brand_engine: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(scores over All with engine diversity, scores for each engine without it). A null part makes a null score."""
    w = cfg.vis_weights
    engines = pairs.select("answer_id", "brand").join(answers.select("answer_id", "engine"), "answer_id")
    reach = engines.groupBy("brand").agg((F.countDistinct("engine") / len(cfg.engines)).alias("reach"))
    named = brand_engine.where("n_answers_mentioning > 0").join(authority(answers, pairs, citations, domains, cfg.authority_values), ["engine", "brand"], "left").join(reach, "brand", "left")
    top = F.max("pawc").over(Window.partitionBy("engine"))
    rows = named.select(
        "brand", "engine", F.col("n_answers_mentioning").alias("n_answers"), (F.col("n_answers_mentioning") < cfg.low_n_answers).alias("low_n"), "pawc",
        F.when(top == 0, 0.0).otherwise(F.try_divide(F.col("pawc"), top)).alias("pawc_norm"), "authority",
        ((F.col("sentiment_mean") + 1) / 2).alias("sentiment_norm"), F.when(F.col("engine") == "All", F.col("reach")).alias("diversity"),
    )
    three = F.col("pawc_norm") * w["pawc"] + F.col("authority") * w["authority"] + F.col("sentiment_norm") * w["sentiment"]
    weight = w["pawc"] + w["authority"] + w["sentiment"]
    whole = rows.where("engine = 'All'").withColumn("vis", 100 * (three + F.col("diversity") * w["diversity"]) / (weight + w["diversity"]))
    each = rows.where("engine <> 'All'").withColumn("vis", 100 * three / weight)
    return whole, each
