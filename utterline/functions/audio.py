"""Sound as columns: decoding, frames, levels. Only PCM WAV is decoded here; other endings are listed but need a decoder of the caller's."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Sample rate and hop of loudness frames, and the length of a frame. Fixed values.
RATE, HOP, FRAME = 16_000, 256, 2048


def decode(content: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 and their rate; nothing at rate 0 for what can't be read."""
    try:
        with wave.open(io.BytesIO(content or b"")) as f:
            width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32), 0
    if width not in (1, 2, 3, 4):
        return np.zeros(0, np.float32), 0
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 3:  # as the upper bytes of 32 bits
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        raw, width = wide.tobytes(), 4
    x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1), rate


def to_pcm16(x: np.ndarray) -> bytes:
    return (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()


def from_pcm16(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i2").astype(np.float32) / 32768


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation to another rate."""
    n = int(len(x) * to / rate) if rate else 0
    return x if rate == to else np.interp(np.arange(n) * (rate / to), np.arange(len(x)), x).astype(np.float32) if n else x[:0]


def fit_length(x: np.ndarray, n: int) -> np.ndarray:
    """Repeated up to ``n`` samples, or the middle ``n`` of a longer one; silence for none."""
    if not len(x):
        return np.zeros(n, np.float32)
    if len(x) < n:
        return np.tile(x, -(-n // len(x)))[:n]
    at = (len(x) - n) // 2
    return x[at : at + n]


def level_to(x: np.ndarray, dbfs: float = -20.0) -> np.ndarray:
    """Scaled so that its root mean square is ``dbfs`` decibels under full scale; silence stays."""
    rms = float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0
    return np.clip(x * (10 ** (dbfs / 20) / rms), -1, 1).astype(np.float32) if rms else x


def without_silence(x: np.ndarray, rate: int, dbfs: float = -40.0, least: float = 0.5) -> np.ndarray:
    """Without stretches of ``least`` seconds and more whose 10 ms blocks are all under ``dbfs``."""
    step = max(1, rate // 100)
    blocks = [x[i : i + step] for i in range(0, len(x), step)]
    quiet = np.array([np.sqrt(np.mean(np.square(b, dtype=np.float64))) < 10 ** (dbfs / 20) for b in blocks], bool)
    edges = np.flatnonzero(np.diff(np.r_[0, quiet.astype(int), 0]))
    for a, b in edges.reshape(-1, 2):
        quiet[a:b] = (b - a) * step >= least * rate
    kept = [b for b, q in zip(blocks, quiet, strict=True) if not q]
    return np.concatenate(kept) if kept else x[:0]


def rms(x: np.ndarray, hop: int = HOP, frame: int = FRAME) -> np.ndarray:
    """Root mean square of frames centred on every ``hop``-th sample, with silence beyond the ends; in pieces, so memory stays small."""
    if not len(x):
        return np.zeros(0)
    sums = np.r_[0.0, np.cumsum(np.square(x, dtype=np.float64))]
    at = np.arange(0, len(x) + 1, hop)
    return np.sqrt(np.maximum(0, sums[np.clip(at + frame // 2, 0, len(x))] - sums[np.clip(at - frame // 2, 0, len(x))]) / frame)


@F.pandas_udf(T.DoubleType())
def duration(content: pd.Series) -> pd.Series:
    """Seconds by the header; 0 for what can't be read."""
    def one(c: bytes | None) -> float:
        try:
            with wave.open(io.BytesIO(c or b"")) as f:
                return f.getnframes() / f.getframerate()
        except (wave.Error, EOFError, ZeroDivisionError):
            return 0.0

    return content.map(one)


def rms_frames(files: DataFrame, rate: int = RATE, hop: int = HOP) -> DataFrame:
    """file_name, frame, rms of each file's frames. A file passes through one task, its frames leave in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["file_name"], pdf["content"], strict=True):
                x, own = decode(content)
                levels = rms(resample(x, own, rate), hop)
                for i in range(0, len(levels), 100_000):
                    part = levels[i : i + 100_000]
                    yield pd.DataFrame({"file_name": name, "frame": np.arange(i, i + len(part)), "rms": part})

    ship(files.sparkSession)
    return files.select("file_name", "content").mapInPandas(run, "file_name string, frame long, rms double")


def phrase_loudness(frames: DataFrame, phrases: DataFrame, phrase_id: str, rate: int = RATE, hop: int = HOP) -> DataFrame:
    """phrase_id and mean, max, min, deviation, range, p95, p75, p25 and count of the frames of each phrase (file_name, start, end); zeros where it has none.

    A phrase meets the frames of its file in slots of 4096, so the join is on equal keys and no phrase is spread over its frames.
    """
    slot, first, last = 4096, F.greatest(F.lit(0), F.floor(F.col("start") * rate / hop)), F.floor(F.col("end") * rate / hop)
    spans = phrases.select(phrase_id, "file_name", first.alias("_a"), last.alias("_b"))
    slots = spans.where("_a < _b").withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_a") / slot), F.floor((F.col("_b") - 1) / slot))))
    met = slots.join(frames.withColumn("_slot", F.floor(F.col("frame") / slot)), ["file_name", "_slot"]).where("frame >= _a AND frame < _b")
    q = F.percentile("rms", F.array(F.lit(0.95), F.lit(0.75), F.lit(0.25)))
    stats = met.groupBy(phrase_id).agg(F.avg("rms").alias("mean_loudness"), F.max("rms").alias("max_loudness"), F.min("rms").alias("min_loudness"), F.stddev_pop("rms").alias("std_loudness"), (F.max("rms") - F.min("rms")).alias("dynamic_range"),
                                       F.get(q, 0).alias("loudness_95th"), F.get(q, 1).alias("loudness_75th"), F.get(q, 2).alias("loudness_25th"), F.count("*").alias("num_frames"))
    return phrases.select(phrase_id).join(stats, phrase_id, "left").fillna(0)


def cmvn(x: np.ndarray) -> np.ndarray:
    """Less its mean, over its deviation; by 1 where that is next to nothing."""
    if not len(x):
        return x
    deviation = float(x.std())
    return ((x - float(x.mean())) / (deviation if np.isfinite(deviation) and deviation >= 1e-6 else 1.0)).astype(np.float32)


def less_noise(x: np.ndarray, rate: int, quiet: float = 0.1, keep: float = 0.1, size: int = 1024) -> np.ndarray:
    """Spectral gating: frequencies near the level that they have in the quietest tenth (``quiet``) of frames are turned down to ``keep``."""
    if len(x) < 2 * size:
        return x
    hop, window = size // 2, np.hanning(size + 1)[:-1].astype(np.float32)
    frames = np.stack([x[i : i + size] * window for i in range(0, len(x) - size + 1, hop)])
    spectrum = np.fft.rfft(frames)
    level = np.abs(spectrum)
    calm = level[np.argsort(level.sum(axis=1))[: max(1, int(len(frames) * quiet))]].mean(axis=0)
    out, got = np.zeros(len(x)), np.fft.irfft(spectrum * np.where(level > 2.5 * calm, 1.0, keep), size)
    for k, f in enumerate(got):
        out[k * hop : k * hop + size] += f
    weight = np.zeros(len(x))
    for k in range(len(frames)):
        weight[k * hop : k * hop + size] += window
    return np.where(weight > 0.1, out / np.maximum(weight, 0.1), x).astype(np.float32)


def trimmed(x: np.ndarray, rate: int, most: float = 300.0) -> np.ndarray:
    """The first ``most`` seconds, at the rate that models take."""
    return resample(x[: int(most * rate)], rate)


def normalised(v: Column) -> Column:
    """A vector less its mean, over its deviation; by 1 where that is next to nothing. Null components count in neither."""
    once = lambda c, f: F.get(F.transform(F.array(c), f), 0)  # noqa: E731 - what a lambda of an array holds is computed once, not for each component
    real = F.transform(v, lambda x: x.cast("double"))
    mean = lambda y: F.aggregate(y, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)), lambda s: F.try_divide(s, F.size(F.array_compact(y))))
    scaled = lambda y: once(F.sqrt(mean(F.transform(y, lambda x: x * x))), lambda d: F.when(d < 1e-6, y).otherwise(F.transform(y, lambda x: x / d)))
    return once(real, lambda w: once(mean(w), lambda m: once(F.transform(w, lambda x: x - m), scaled)))
