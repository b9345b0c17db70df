"""Sentences attributed to the cited page that holds most of their word pairs. Outside of the metric tables.

A sentence's grams are its distinct pairs of neighbouring content words, or its content words where it has fewer than
three. Grams are 64-bit hashes. No row for each gram of each cited page is made: an answer sends the 16-bit ends of its
grams to the pages that it cites, once each, and a page answers with those of its whole grams whose ends were among them.
That leaves out nothing that both have, and what has the same end only is found out by the whole grams, beside the
answer's sentences. A page which very many answers cite is split by the skew join, and no group is larger than an
answer's sentences or citations.

A null or empty text has no grams: the sentence stays, unattributed, with score 0. A page that an answer cites twice
counts with its better rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..plans.shipping import ship

THRESHOLD, SHORT = 0.30, 3
FOUND = "array<struct<sent_idx: int, n: int, k: int>>"


def content_words(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.expr("cast(array() as array<string>)")
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w))


def _pairs(words: Column) -> Column:
    at = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda k: F.xxhash64(F.concat_ws(" ", F.element_at(words, k), F.element_at(words, k + 1))))


def _singles(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _ends(grams: Column) -> Column:
    """The last 16 bits of each gram, distinct."""
    return F.array_distinct(F.transform(grams, lambda g: (g.bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("short")))


def _lists(a: pa.ListArray) -> Iterator[np.ndarray]:
    """The numbers of each row, in turn."""
    values, at = a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()
    return (values[start:end] for start, end in zip(at[:-1], at[1:], strict=True))


def _met(ends: pa.Array, grams: pa.Array) -> pa.Array:
    """Of a page's grams those whose ends are among the answer's."""
    known, out = np.zeros(1 << 16, bool), []
    for mine, theirs in zip(_lists(ends), _lists(grams), strict=True):
        known[mine.astype(np.int64) + 0x8000] = True
        out.append(theirs[known[theirs & 0xFFFF]])
        known[:] = False
    return pa.array(out, pa.list_(pa.int64()))


def _counted(own: pa.Array, page_grams: pa.Array) -> pa.Array:
    """sent_idx, its grams and how many of them the page has, for every sentence of the answer that has any."""
    sentences, out = own.values, []
    numbers, starts = sentences.field("sent_idx").to_numpy(zero_copy_only=False), sentences.field("grams").offsets.to_numpy()
    grams, at = sentences.field("grams").values.to_numpy(zero_copy_only=False), own.offsets.to_numpy()
    for first, last, theirs in zip(at[:-1], at[1:], _lists(page_grams), strict=True):
        edges = starts[first : last + 1]
        before = np.concatenate([[0], np.cumsum(np.isin(grams[edges[0] : edges[-1]], theirs))])
        k = np.diff(before[edges - edges[0]])
        out.append([{"sent_idx": int(numbers[first + i]), "n": int(edges[i + 1] - edges[i]), "k": int(k[i])} for i in np.nonzero(k)[0]])
    return pa.array(out, pa.list_(pa.struct([("sent_idx", pa.int32()), ("n", pa.int32()), ("k", pa.int32())])))


def attributed(sentences: DataFrame, citations: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """sentences (answer_id, sent_idx, text), citations (answer_id, rank, url), texts (url, text) of readable pages ->
    answer_id, sent_idx, best_url, score, second_score, attributed: a row for every sentence. Ties go to the better rank."""
    ship(sentences.sparkSession)
    own = bound(content_words(F.col("text"), stopwords), lambda w: F.array_distinct(F.when(F.size(w) < SHORT, _singles(w)).otherwise(_pairs(w))))
    asked = sentences.select("answer_id", F.col("sent_idx").cast("int").alias("sent_idx"), own.alias("grams")).repartition("answer_id")
    whole = asked.groupBy("answer_id").agg(F.collect_list(F.struct("sent_idx", "grams")).alias("own"))  # an answer's sentences
    both = bound(content_words(F.col("text"), stopwords), lambda w: F.array_distinct(F.concat(_singles(w), _pairs(w))))
    cited = citations.repartition("answer_id").groupBy("answer_id", "url").agg(F.min("rank").alias("rank"))
    ends = whole.select("answer_id", _ends(F.flatten(F.transform("own", lambda x: x["grams"]))).alias("ends"))
    sent = cited.join(ends, "answer_id").join(texts.select("url", both.alias("grams")), "url")
    met = sent.select("answer_id", "url", "rank", F.arrow_udf(_met, "array<long>")("ends", "grams").alias("page_grams")).where(F.size("page_grams") > 0)
    each = met.join(whole, "answer_id").select("answer_id", "url", "rank", F.explode(F.arrow_udf(_counted, FOUND)("own", "page_grams")).alias("s")).select("answer_id", "url", "rank", "s.*")
    rated = F.struct((F.col("k") / F.col("n")).alias("score"), (-F.col("rank")).alias("by"), "url")
    top = each.groupBy("answer_id", "sent_idx").agg(F.slice(F.sort_array(F.collect_list(rated), False), 1, 2).alias("top"))  # of an answer's citations
    found = sentences.select("answer_id", "sent_idx").join(top, ["answer_id", "sent_idx"], "left")
    score = lambda k: F.coalesce(F.get("top", F.lit(k))["score"], F.lit(0.0))
    return found.select(
        "answer_id", "sent_idx", F.when(score(0) >= threshold, F.get("top", F.lit(0))["url"]).alias("best_url"), score(0).alias("score"), score(1).alias("second_score"), (score(0) >= threshold).alias("attributed")
    )
