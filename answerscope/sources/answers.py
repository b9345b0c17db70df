"""Answers and citations from a wide sheet of prompts and engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.sentences import strip
from ..operators.reshape import override, unpivot_engines
from ..plans.config import Config


def load_answers(sheet: DataFrame, reruns: DataFrame | None, cfg: Config) -> DataFrame:
    """One row for each prompt and engine. sheet: #, Pillar, Intent, Prompt and a column for each engine; reruns: prefix, prompt_no, answer_raw."""
    wide = sheet.select(F.col("#").cast("double").cast("int").alias("prompt_no"), F.col("Pillar").alias("pillar"), F.col("Intent").alias("intent"), F.col("Prompt").alias("prompt"), *cfg.engines)
    long = unpivot_engines(wide, ["prompt_no", "pillar", "intent", "prompt"], list(cfg.engines))
    prefix = F.create_map(*[F.lit(x) for kv in cfg.engines.items() for x in kv])[F.col("engine")]
    long = long.withColumn("prefix", prefix)
    if reruns is not None:
        long = override(long, reruns, ["prefix", "prompt_no"], "answer_raw")
    return long.select(
        urls.answer_id(F.col("prefix"), F.col("prompt_no")).alias("answer_id"), "engine", "prompt_no", "pillar", "intent", "prompt",
        urls.newlines(F.col("answer_raw")).alias("answer_raw"), F.lit(cfg.run_date).cast("date").alias("run_date"),
    )


def with_sections(answers: DataFrame) -> DataFrame:
    """answers with answer_body and section; an answer without a source heading is an error."""
    raw = F.col("answer_raw")
    return answers.withColumn("answer_body", strip(urls.answer_body(raw))).withColumn("section", urls.citation_section(raw))
