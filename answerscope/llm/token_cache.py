"""Operator 2: token counts by way of a cache of digests.

The cache is a Parquet table of (content digest, tokenizer digest, n_tokens). A call digests the normalised texts into
a narrow table, finds the digests that stand in several rows or that the cache already has under this tokenizer's
digest, and encodes each miss once: a text whose digest is surely alone where it stands, the others after one row of
each content was kept and those in the cache were dropped. Their counts are appended to the cache, and every document's
digest joins the stored counts. So only texts with copies (and a few that a bitmap takes for such) are shuffled, and a
content that many documents share is encoded once.

Normalised content: the UTF-8 text, null as the empty one, with U+2581 written as a space. The tokenizer itself writes
spaces as U+2581 before it looks at anything else, so both spellings give the same pieces; nothing else is folded,
since this tokenizer has no other normalisation and any other change could change a count.

The tokenizer digest covers the model file, the library's version and the normalisation, so that a changed tokenizer
never meets old counts. Appending is one Parquet write: a failed job leaves nothing, and two jobs that append the same
digest store the same count, which reading collapses.

Empty tables give no rows; repeated rows each give their row; null and empty texts have 0 tokens; other columns are
not read, whatever their names. Whole texts are encoded, however long: a long one in slices, cut before a word that
follows a single space. No piece of the vocabulary holds a space after another character, so none spans such a cut,
and the mark that the tokenizer puts before a slice stands for the space that was cut. Where a vocabulary has such
pieces, texts are not sliced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, marked, new_path, stored, table

SCHEMA = "digest binary, version string, n_tokens long"
LIMIT = 4096
#: Characters that go to the library at once, as one slice of a text or as several texts.
SLICE = 1 << 16
#: A space alone between two characters that are neither spaces nor what the tokenizer makes of them.
CUT = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")

_models: dict[str, Counter] = {}


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.sliceable = not any("▁" in p.lstrip("▁") for p in pieces)

    def slices(self, text: str) -> list[str]:
        if not self.sliceable or len(text) <= SLICE:
            return [text]
        out, start = [], 0
        while len(text) - start > SLICE and (m := CUT.search(text, start + SLICE - 1)):
            out.append(text[start : m.start()])
            start = m.end()
        return [*out, text[start:]]

    def counts(self, texts: Iterable[str]) -> list[int]:
        out, held, of, size = [], [], [], 0

        def send() -> None:
            for k, ids in zip(of, self.model.encode(held, num_threads=1), strict=True):
                out[k] += len(ids)

        for k, text in enumerate(texts):
            out.append(0)
            for part in self.slices(text):
                held.append(part)
                of.append(k)
                size += len(part)
                if size >= SLICE:
                    send()
                    held, of, size = [], [], 0
        if held:
            send()
        return out


def model(path: str) -> Counter:
    """One for each Python worker."""
    if path not in _models:
        _models[path] = Counter(path)
    return _models[path]


def version_of(path: str) -> str:
    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|sentencepiece {sentencepiece.__version__}|u2581=space".encode()).hexdigest()


def normalised(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("▁"), F.lit(" "))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    try:
        stored = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], SCHEMA)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(misses: DataFrame, model_path: str, version: str) -> DataFrame:
    """(digest, text) -> rows of the cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = model(model_path).counts(t.as_py() for t in b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([version] * len(b), pa.string()), pa.array(counts, pa.int64())], names=["digest", "version", "n_tokens"])

    return arrow(misses.select("digest", "text"), run, SCHEMA)


def fill(docs: DataFrame, cache_path: str, model_path: str, text_col: str = "text", digests: DataFrame | None = None) -> str:
    """Appends the counts of docs' contents that the cache lacks; returns the tokenizer's digest. digests: those of all rows, if they are stored."""
    spark, version = docs.sparkSession, version_of(model_path)
    cached = read_cache(spark, cache_path, version).select("digest")
    rows = docs.select(digest(F.col(text_col)).alias("digest"), normalised(F.col(text_col)).alias("text"))
    found = (rows if digests is None else digests).groupBy("digest").agg((F.count("*") > 1).alias("several"))
    found = found.join(cached.withColumn("known", F.lit(True)), "digest", "left")
    apart = stored(found.where(F.col("several") | F.col("known")).select("digest"), "several_or_known")
    told = marked(rows, F.col("digest"), apart, "apart")
    alone = told.where(~F.col("apart")).select("digest", "text")
    distinct = told.where("apart").groupBy("digest").agg(F.first("text").alias("text"))
    misses = alone.unionByName(distinct.join(cached, "digest", "left_anti"))
    encoded(misses, model_path, version).write.mode("append").parquet(cache_path)
    return version


def counted(docs: DataFrame, cache_path: str, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, every count read from the cache."""
    version = fill(docs, cache_path, model_path, text_col)
    cache = stored(read_cache(docs.sparkSession, cache_path, version), "token_counts").select(F.col("digest").alias("__digest"), F.col("n_tokens").alias("__n"))
    rows = docs.withColumn("__digest", digest(F.col(text_col)))
    kept = [c for c in docs.columns if c != "n_tokens"]
    return rows.join(cache, "__digest").select(*kept, F.col("__n").alias("n_tokens"))


def op2_token_cache(spark, sf_dir: str) -> DataFrame:
    """The cache starts empty for each call, unless the session names a lasting one in answerscope.token_cache."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keyed = stored(docs.select("doc_id", n_bytes.alias("n_bytes"), digest(F.col("text")).alias("digest")), "digests")
    path = spark.conf.get("answerscope.token_cache", None) or new_path(spark, "token_cache")
    version = fill(docs, path, public_tokenizers.path("piece_bpe_32k.model"), digests=keyed.select("digest"))
    # stored, so that the join's sides are plain exchanges and a content of very many documents can be split
    return keyed.join(stored(read_cache(spark, path, version), "token_counts"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
