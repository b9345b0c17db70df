"""Operator 1: media columns. Texts are stored as WAV, read back by the wave module and fingerprinted.

A text's UTF-8 bytes, zero-padded to a positive multiple of 64, are the 8-bit samples of a mono WAV file. Reading the
file gives the samples back byte for byte; from them come short-time Fourier transforms (Hann windows of FRAME samples,
HOP apart), the strongest spectral peak of each band that also stands out in time, and pairs of peaks as landmarks: an
anchor with the next FAN peaks within REACH frames. A fingerprint is stored as two arrays, times and codes, where a
code holds both bands' frequencies and their distance in time.

The features are of the samples alone: the transform is computed in fixed blocks of frames, so equal texts have equal
values wherever they stand, and a long text takes bounded memory beyond its own samples.

Nulls: a null text is an empty one, 64 zero samples, with no peaks. Repeated rows get equal results; an empty table
gives no rows; other columns, also ones named like the results, are not read by the query and kept by the functions
unless they have the name of a result, which then wins.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, table

UNIT = 64
RATE = 8000
FRAME, HOP = 256, 128
#: Edges of the bands of frequency bins; the constant part is left out.
BANDS = (1, 9, 25, 57, 129)
FAN, REACH = 3, 32
#: A peak is this many times its band's mean magnitude at least.
STANDS_OUT = 2.0
BLOCK_FRAMES = 4096


def payload(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the peaks, by frame and band."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.full((n - 1) * HOP + FRAME - len(x), 128, np.uint8)]) if (n - 1) * HOP + FRAME > len(x) else x
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    hann = np.hanning(FRAME).astype(np.float32)
    n_bands = len(BANDS) - 1
    top, where = np.zeros((n, n_bands), np.float32), np.zeros((n, n_bands), np.int64)
    for at in range(0, n, BLOCK_FRAMES):
        block = (frames[at : at + BLOCK_FRAMES].astype(np.float32) - 128) * hann
        power = np.abs(np.fft.rfft(block, axis=1)).astype(np.float32)
        for k in range(n_bands):
            band = power[:, BANDS[k] : BANDS[k + 1]]
            best = band.argmax(axis=1)
            strength = band[np.arange(len(band)), best]
            top[at : at + len(band), k] = np.where(strength >= STANDS_OUT * band.mean(axis=1), strength, 0)
            where[at : at + len(band), k] = best + BANDS[k]
    around = np.pad(top, ((1, 1), (0, 0)))
    stands = (top > 0) & (top >= around[:-2]) & (top > around[2:])
    frame, band = np.nonzero(stands)
    return frame, where[frame, band]


def landmarks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): the anchor's frame, and anchor bin * 2^16 + other bin * 2^6 + frames between."""
    frame, bins = peaks(samples)
    times, codes = [], []
    for step in range(1, FAN + 1):
        gap = frame[step:] - frame[:-step]
        ok = (gap >= 0) & (gap <= REACH)
        times.append(frame[:-step][ok])
        codes.append((bins[:-step][ok] << 16) | (bins[step:][ok] << 6) | gap[ok])
    t, c = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (times, codes))
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def _mapped(df: DataFrame, added: str, compute) -> DataFrame:
    """df with the columns of the schema string added; compute takes a row batch and gives their arrays."""
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    names = [c for c in df.columns if c not in new.names]
    schema = df.select(*names).schema
    for f in new.fields:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *compute(b)], names=[*names, *new.names])

    return arrow(df, run, schema)


def store(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with media: the text's bytes as a WAV file."""
    return _mapped(df, "media binary", lambda b: [pa.array([to_wav(payload(t.as_py())) for t in b.column(text_col).cast(pa.binary())], pa.binary())])


def features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with what the stored media say: sizes, digests, and the fingerprint's fp_times and fp_codes."""
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fp_times array<int>, fp_codes array<int>"

    def compute(b: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for stored in b.column(media_col):
            media = stored.as_py()
            samples = from_wav(media)
            t, c = landmarks(samples)
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), t, c))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return [pa.array(v, t) for v, t in zip(columns, types, strict=True)]

    return _mapped(df, added, compute)


def op1_media_wav(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    found = features(store(docs).drop("text")).drop("media")
    pairs = F.concat_ws(",", F.array_join("fp_times", " "), F.array_join("fp_codes", " "))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", F.size("fp_codes"), F.sha2(pairs, 256)).alias("feature"),
        F.size("fp_codes").cast("long").alias("n_landmarks"), "fp_times", "fp_codes",
    )
