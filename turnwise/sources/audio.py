"""Recordings as sample arrays: PCM WAV decoding, reading parts, and low-energy cuts."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from turnwise.functions.lazy import lazy_udf


def samples(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples from -1 to 1) of a PCM WAV file of 8, 16 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        rate, width, channels, raw = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(axis=1)


@lazy_udf("struct<rate:int,duration_ms:bigint,samples:array<float>>")
def decoded(content: pd.Series) -> pd.DataFrame:
    rows = []
    for c in content:
        rate, x = samples(c)
        rows.append((rate, round(len(x) * 1000 / rate), x.tolist()))
    return pd.DataFrame(rows, columns=["rate", "duration_ms", "samples"])


def recordings(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    """path, rate, duration_ms, samples."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select("path", decoded("content").alias("a")).select("path", "a.*")


def quiet_cuts(x: np.ndarray, rate: int, most_s: float, search_s: float = 2.0, frame_s: float = 0.05) -> list[tuple[int, int]]:
    """(first sample, end) of chunks of up to ``most_s``, cut at the quietest frame of the last ``search_s``."""
    out, at, frame = [], 0, max(1, int(frame_s * rate))
    while len(x) - at > most_s * rate:
        hi = at + int(most_s * rate)
        lo = max(at + frame, hi - int(search_s * rate))
        starts = np.arange(lo, hi, frame)
        power = [float(np.square(x[s : s + frame]).mean()) for s in starts]
        cut = int(starts[int(np.argmin(power))])
        out.append((at, cut))
        at = cut
    return [*out, (at, len(x))]


@lazy_udf("array<struct<first:bigint,end:bigint>>")
def chunked(values: pd.Series, rates: pd.Series, most_s: pd.Series) -> pd.Series:
    return pd.Series([[{"first": a, "end": b} for a, b in quiet_cuts(np.asarray(v, np.float32), int(r), float(m))] for v, r, m in zip(values, rates, most_s, strict=True)])
