"""PCM conversion, levels and slicing as column expressions, and resampling in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STT_RATE = 16_000
WINDOW_SECONDS = 0.02
SILENT_RMS = 1e-12


def i16_from_float(sample: Column) -> Column:
    """Clamped to [-1, 1], scaled by 32767 and rounded half away from zero; NaN is 0."""
    clamped = F.greatest(F.least(sample.cast("double"), F.lit(1.0)), F.lit(-1.0))
    return F.when(F.isnan(sample), F.lit(0).cast("smallint")).otherwise(F.round(clamped * 32767).cast("smallint"))


def i16_from_u16(sample: Column) -> Column:
    return (sample.cast("int") - 32768).cast("smallint")


def frames_for(rate: Column, seconds: float) -> Column:
    return F.round(rate.cast("double") * seconds).cast("bigint")


def windows_for(ms: Column, window_ms: int = 20) -> Column:
    return F.ceil(ms / window_ms)


def frame_level(frame: Column) -> Column:
    """Mean of a frame's channels, in units of full scale."""
    return F.aggregate(frame, F.lit(0.0), lambda a, s: a + s / F.lit(32768.0), lambda a: a / F.size(frame))


def mono(samples: Column, channels: Column) -> Column:
    """Frames of interleaved 16-bit samples as the float mean of their channels; an incomplete frame is an error."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    mixed = F.transform(F.sequence(F.lit(0), frames - 1), lambda f: frame_level(F.slice(samples, f * channels + 1, channels)).cast("float"))
    return (
        F.when((channels <= 0) | (F.size(samples) % F.greatest(channels, F.lit(1)) != 0), F.raise_error(F.lit("recorded audio contains an incomplete frame")).cast("array<float>"))
        .when(frames == 0, F.array().cast("array<float>"))
        .otherwise(mixed)
    )


def dbfs(rms: Column) -> Column:
    return 20 * F.log10(F.greatest(rms, F.lit(SILENT_RMS)))


def pre_roll_start(started: Column, rate: Column, seconds: float = 0.3) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), started - frames_for(rate, seconds))


def slice_frames(samples: Column, channels: Column, start: Column, end: Column) -> Column:
    """Frames [start, end) of interleaved samples; a range out of bounds is an error."""
    frames = F.floor(F.size(samples) / channels)
    part = F.slice(samples, (start * channels + 1).cast("int"), ((end - start) * channels).cast("int"))
    return F.when((start < 0) | (start > end) | (end > frames), F.raise_error(F.lit("frame range is out of bounds")).cast("array<smallint>")).otherwise(part)


def meter(level: Column, cells: int = 20, low: float = -60.0) -> Column:
    """Filled cells of a level meter."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (level - low) / -low))
    filled = F.round(share * cells).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(cells) - filled))


#: Of the resampling filter, in shares of the lower of both band limits: what is below PASS is kept, what is above it falls
#: until the limit, beyond which it is at least 70 dB down.
PASS = 0.92
#: Taps (at the higher rate, each side) of a filter that falls within 1 - PASS, by a Blackman window's width of 5.5 / taps.
SIDE = 70
#: Output samples that are made at once.
STEP = 4096


class Resampler:
    """Band-limited resampling of a signal that comes in blocks; what is held is the filter's width, and any blocks give the same.

    An output sample is the sum of the input samples about its place, weighted by a windowed sinc; the weights of a place add up
    to one. Before and after the signal is silence.
    """

    def __init__(self, source: int, target: int) -> None:
        if source <= 0 or target <= 0:
            raise ValueError("sample rate must be positive")
        common = gcd(source, target)
        self.up, self.down = target // common, source // common
        self.ratio = min(1.0, target / source)
        self.half = ceil(SIDE / self.ratio)
        self.held, self.first = np.zeros(self.half - 1), 1 - self.half
        self.taken = self.made = 0
        self.table = self._weights(np.arange(self.up)) if self.up <= STEP else None

    def _weights(self, phases: np.ndarray) -> np.ndarray:
        """For places of phase / up behind a sample: the weights of half - 1 samples before it, itself and half after it."""
        x = phases[:, None] / self.up + (self.half - 1 - np.arange(2 * self.half))
        along = np.pi * x / self.half
        window = np.where(np.abs(x) < self.half, 0.42 + 0.5 * np.cos(along) + 0.08 * np.cos(2 * along), 0.0)
        w = window * np.sinc(x * self.ratio * (1 + PASS) / 2)
        return w / w.sum(axis=1, keepdims=True)

    def _upto(self, end: int) -> np.ndarray:
        out = [np.zeros(0)]
        while self.made < end:
            n = np.arange(self.made, min(end, self.made + STEP))
            at, phase = np.divmod(n * self.down, self.up)
            weights = self._weights(phase) if self.table is None else self.table[phase]
            windows = np.lib.stride_tricks.sliding_window_view(self.held, 2 * self.half)[at - self.half + 1 - self.first]
            out.append((windows * weights).sum(axis=1))
            self.made = int(n[-1]) + 1
        keep = self.made * self.down // self.up - self.half + 1
        if keep > self.first:
            self.held, self.first = self.held[keep - self.first :], keep
        return np.concatenate(out)

    def feed(self, samples: np.ndarray) -> np.ndarray:
        """The output samples that can be made with another block of input."""
        self.held = np.concatenate([self.held, np.asarray(samples, np.float64)])
        self.taken += len(samples)
        return self._upto(max(0, -(-(self.taken - self.half) * self.up // self.down)))

    def end(self) -> np.ndarray:
        """The rest: round(n * target / source) samples in all, one at least."""
        if not self.taken:
            return np.zeros(0)
        total = max(1, (2 * self.taken * self.up + self.down) // (2 * self.down))
        self.held = np.concatenate([self.held, np.zeros(2 * self.half)])
        return self._upto(total)


def resampled(samples: np.ndarray, source: int, target: int = STT_RATE, block: int = 1 << 16, kind: type = np.float32) -> np.ndarray:
    """Band-limited resampling; round(n * target / source) samples."""
    resampler = Resampler(source, target)
    if source == target or not len(samples):
        return np.asarray(samples).astype(kind)
    blocks = [resampler.feed(samples[k : k + block]).astype(kind) for k in range(0, len(samples), block)]
    return np.concatenate([*blocks, resampler.end().astype(kind)])


#: Samples that go back to the engine at once; with the recording that reaches them a batch ends.
BATCH_SAMPLES = 1 << 20


def in_parts(batches: Iterator[tuple[pd.Series, ...]], made: Callable[..., np.ndarray], most: int = BATCH_SAMPLES) -> Iterator[pd.Series]:
    """What `made` makes of each row's samples (null for null), in batches of about `most` samples, however many rows come at once."""
    for columns in batches:
        out: list = []
        size = 0
        for samples, *more in zip(*columns):
            out.append(None if samples is None else made(samples, *map(int, more)))
            size += 0 if samples is None else len(out[-1])
            if size >= most:
                yield pd.Series(out, dtype=object)
                out, size = [], 0
        if out:
            yield pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resample_to(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Mono samples (rows of samples, rate and target) at another rate."""
    return in_parts(rows, lambda s, rate, target: resampled(np.asarray(s, np.float64), rate, target, kind=np.float64))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def resample(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Mono float samples (rows of samples and rate) at 16 kHz."""
    return in_parts(rows, lambda s, rate: resampled(np.asarray(s, np.float64), rate))


def stt_samples(samples: np.ndarray, rate: int, channels: int) -> np.ndarray:
    """Mono 16 kHz float samples of interleaved 16-bit ones; an invalid recording is an error."""
    if rate <= 0 or not len(samples):
        raise ValueError("recording has no samples or no sample rate")
    if channels <= 0 or len(samples) % channels:
        raise ValueError("recorded audio contains an incomplete frame")
    return resampled(np.asarray(samples, np.float64).reshape(-1, channels).mean(axis=1) / 32768, rate)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def prepare_for_stt(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """stt_samples of each recording (rows of samples, rate and channels); null for null."""
    return in_parts(rows, stt_samples)
