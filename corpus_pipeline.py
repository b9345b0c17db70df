"""A corpus from documents: language, near-duplicates, benchmark passages, secrets, and packing into windows.

Each stage works on all that the one before kept, and its result is written as Parquet and read again. All stages but
the last return the columns of documents; other columns, whatever their names, are left out. Empty tables pass through
as empty ones. Repeated rows are near-duplicates of each other, so one of them stays. A null doc_id is a document like
any other, and is the one that stays only where its group has no id. Texts are read whole, however long, in batches of
bounded bytes; of equally good rows of a group (same id, another text) the one with the smallest text hash stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm.common import ship, stored, table
from answerscope.llm.credentials import redacted, with_spans
from answerscope.llm.decontamination import clean
from answerscope.llm.language import lettered, predicted, train
from answerscope.llm.packing import pack
from answerscope.llm.simhash import one_of_each

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts without any language: null ones and those without a letter. Labels are learned from, not kept to; without any, all else stays.

    A document without a label gets the language that the codes decide on: not where two are close, or none but one is known.
    """
    ship(spark)
    fitted = train(docs)
    if fitted is None:
        return lettered(docs.select(*COLUMNS))
    found = predicted(docs.select(*COLUMNS), fitted)
    found = found.where(F.col("score") > 0)  # a label may be "und"
    if len(fitted.languages) > 1:
        found = found.withColumn("lang", F.coalesce(F.col("lang"), F.when(~F.col("ambiguous"), F.col("lang_pred"))))
    return found.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of linked fingerprints: that with the smallest doc_id."""
    ship(spark)
    return one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark window; texts without words hold none."""
    return clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span found, and counts the text's characters again; null texts stay as they are."""
    found = with_spans(docs.select(*COLUMNS), out="found")
    masked = found.withColumn("text", redacted(F.col("text"), F.col("found")))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens; a null text is its end id alone."""
    ship(spark)
    return pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs


#: Four of the stages can't be said in SQL; a test compares the rows with a brute-force version.
ORACLE_SQL = None
