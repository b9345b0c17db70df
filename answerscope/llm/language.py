"""Operator 5: the language of whole texts, by error-correcting output codes.

Each language has a codeword of bits. One logistic classifier for each bit, over hashed byte n-grams of the letters,
says which half of the languages a text belongs to. Decoding weighs each bit's logistic loss by how well that bit did
on the language's own training texts and takes the codeword of least weighted loss; score is its softmax share, and a
text whose two best codewords are close is flagged as ambiguous.

Training reads only text and lang, of rows that are labelled and not held out (crc32 of doc_id as text, mod 4, is not 2;
a null doc_id is left out too). The sample has the PER_LANGUAGE distinct whole texts of a language with the smallest
hashes, fewer if that would be more than TOTAL in all (but two of each language), and all texts of a language that has
no more. Copies, null texts and texts without letters take no place, so no language with a usable text is left out.
Every row is predicted, from its whole text alone.

Ties: of codewords with equal loss, the language that comes first by name; such a text is ambiguous.

Nulls: `und` with score 0 for a null text or one without any letter, and for every text if nothing is labelled. Repeated
rows get equal results; an empty table gives no rows; other columns are not read. Long texts are counted in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, table

UND = "und"
GRAMS, BINS = (2, 3, 4), 2048
SIZE = len(GRAMS) * BINS
#: The bound of the training sample.
PER_LANGUAGE, TOTAL = 400, 4000
#: Full-batch steps of the bit classifiers.
STEPS, RATE, DECAY = 150, 8.0, 1e-5
#: Two codewords are close if the better one's share is not this much larger.
MARGIN = 0.1
BLOCK = 1 << 20
#: Letters, and what may be one by another version of Unicode; has_letter() decides.
MAYBE_LETTER = r"[\p{L}\p{Cn}]"
#: ASCII other than letters becomes a space.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FACTORS = (2654435761, 2246822519, 3266489917, 668265263)


def features(text: str) -> np.ndarray:
    """Roots of the hashed n-gram counts, of length 1."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()) + b" "
    counts = np.zeros(SIZE)
    for at in range(0, len(raw), BLOCK):
        codes = np.frombuffer(raw[at : at + BLOCK + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        for k, n in enumerate(GRAMS):
            m = min(BLOCK, len(codes) - n + 1)
            if m <= 0:
                continue
            h = np.zeros(m, np.uint32)
            for j in range(n):
                h = (h ^ codes[j : j + m]) * np.uint32(FACTORS[j])
                h ^= h >> np.uint32(15)
            counts[k * BINS : (k + 1) * BINS] += np.bincount(h % np.uint32(BINS), minlength=BINS)
    out = np.sqrt(counts)
    return (out / max(np.linalg.norm(out), 1e-9)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1: every split of the languages if they are few, else the best-spread of some random codes."""
    if n <= 5:
        columns = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.float32).reshape(-1, n).T
    rng, best, spread = np.random.default_rng(5), None, -1
    length = 10 * int(np.ceil(np.log2(n)))
    for _ in range(50):
        code = rng.choice([-1, 1], (n, length))
        apart = ((length - code @ code.T) // 2 + np.eye(n, dtype=int) * length).min()
        if apart > spread and (abs(code.sum(axis=0)) < n).all():
            best, spread = code, apart
    return best.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and whether the runner-up is close."""
        f = x @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None]) * self.trust[None]
        z = -loss.sum(axis=2) * self.code.shape[1]
        share = np.exp(z - z.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        top = share.argmax(axis=1)
        score = share[np.arange(len(x)), top]
        second = np.partition(share, -2, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(x))
        return [self.languages[k] for k in top], score, score - second < MARGIN


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    hashed = labelled.where(F.col("text").rlike(MAYBE_LETTER)).withColumn("h", F.xxhash64("text", "lang"))
    counted = hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    sizes = {r["lang"]: (r["n"], r["least"]) for r in counted.collect()}  # one row for each language
    if not sizes:
        return None
    each = max(2, min(PER_LANGUAGE, TOTAL // len(sizes)))
    wide = each + 8 * math.isqrt(each) + 30  # so many hashes are expected below the limit that `each` are there
    limits = {k: max(least, min((1 << 63) - 1, (wide << 64) // n - (1 << 63))) for k, (n, least) in sizes.items()}
    limit = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])
    near = hashed.where(F.col("h") <= limit[F.col("lang")]).select("lang", "h", "text")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of hashes below the limits
        for b in batches:
            of = []
            for k, (lang, h) in enumerate(zip(b.column("lang").to_pylist(), b.column("h").to_pylist(), strict=True)):
                if (lang, h) not in seen:
                    seen.add((lang, h))
                    if has_letter(b.column("text")[k].as_py()):
                        of.append(k)
            yield b.take(pa.array(of, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(x, pa.binary())], names=["lang", "h", "x"])

    distinct = arrow(near, once, "lang string, h long, text string").groupBy("lang", "h").agg(F.first("text").alias("text"))
    ranked = arrow(distinct, run, "lang string, h long, x binary").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    found = ranked.where(F.col("rank") <= each).select("lang", "x").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["lang", "x"], kind="stable")
    languages = sorted(found["lang"].unique())
    x = np.stack([np.frombuffer(v, np.float32) for v in found["x"]])
    y = np.searchsorted(languages, found["lang"].to_numpy())
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, np.ones((1, 1), np.float32), np.zeros((SIZE + 1, 1), np.float32), np.ones((1, 1), np.float32))
    share = 1 / np.bincount(y)[y] / len(languages)  # languages count alike
    target, weights = code[y], np.zeros((SIZE + 1, code.shape[1]), np.float32)
    for _ in range(STEPS):
        f = x @ weights[:-1] + weights[-1]
        pull = (target / (1 + np.exp(np.clip(target * f, -30, 30))) * share[:, None]).astype(np.float32)
        weights[:-1] += RATE * (x.T @ pull) - RATE * DECAY * weights[:-1]
        weights[-1] += RATE * pull.sum(axis=0)
    right = (x @ weights[:-1] + weights[-1]) * target > 0
    trust = np.stack([right[y == k].mean(axis=0) for k in range(len(languages))]).astype(np.float32) + 1e-6
    return Model(languages, code, weights, trust / trust.sum(axis=1, keepdims=True))


def predicted(docs: DataFrame, fitted: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "ambiguous")]
    names = [f.name for f in kept]
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for b in batches:
            texts = b.column(text_col)
            langs, scores, close = [UND] * len(b), np.zeros(len(b)), np.zeros(len(b), bool)
            for at in range(0, len(b), 256):
                part = [(k, t) for k in range(at, min(at + 256, len(b))) if has_letter(t := texts[k].as_py())]
                if not part or fitted is None:
                    continue
                of = [k for k, _ in part]
                found, scores[of], close[of] = fitted.predict(np.stack([features(t) for _, t in part]))
                for k, name in zip(of, found, strict=True):
                    langs[k] = name
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())], names=[*names, "lang_pred", "score", "ambiguous"])

    return arrow(docs.select(*names), run, schema)


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose texts have a letter, which are those of a score above 0 wherever there is a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([has_letter(t.as_py()) for t in b.column(text_col)], pa.bool_()))

    return arrow(docs, run, docs.schema)


def op5_language_ecoc(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predicted(rows, train(docs)).drop("text")
