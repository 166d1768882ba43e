"""Levels of tumbling windows: RMS and dBFS of every whole window of frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterscope.functions.audio import WINDOW_SECONDS, dbfs, frames_for


def levels_of_frames(frames: DataFrame, keys: Sequence[str], frame: str, value: str, size: int) -> DataFrame:
    """keys, window_idx, rms, dbfs and end_frame from one row a mono frame; a window without all its frames is left out."""
    window = F.floor(F.col(frame) / size)
    summed = frames.groupBy(*keys, window.alias("window_idx")).agg(F.sum(F.col(value) * F.col(value)).alias("__squares"), F.count(F.lit(1)).alias("__n"))
    rms = F.sqrt(F.col("__squares") / size).cast("float")
    return summed.where(F.col("__n") == size).select(*keys, "window_idx", rms.alias("rms"), dbfs(rms.cast("double")).cast("float").alias("dbfs"), ((F.col("window_idx") + 1) * size).alias("end_frame"))


def window_levels(samples: np.ndarray, channels: int, size: int) -> np.ndarray:
    """RMS of each whole window of `size` frames of interleaved 16-bit samples."""
    width = size * channels
    whole = len(samples) // width
    frames = np.asarray(samples[: whole * width], np.float64).reshape(whole, size, channels).sum(axis=2) / (32768.0 * channels)
    return np.sqrt((frames * frames).sum(axis=1) / size).astype(np.float32)


def levels_of_recordings(recordings: DataFrame, keys: Sequence[str] = ("id",), seconds: float = WINDOW_SECONDS) -> DataFrame:
    """The same from one row a recording: samples (interleaved 16-bit), sample_rate_hz and channels."""
    names = [f"__k{i}" for i in range(len(keys))]
    sized = recordings.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], "samples", F.col("channels").cast("int").alias("__channels"),
        frames_for(F.col("sample_rate_hz"), seconds).cast("int").alias("__size"),
    ).where("samples is not null and __channels > 0 and __size > 0")
    fields = [sized.schema[n] for n in names]
    out = T.StructType([*fields, T.StructField("window_idx", T.LongType()), T.StructField("rms", T.FloatType()), T.StructField("end_frame", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, count = batch.num_columns - 3, batch.num_rows
            each = [
                window_levels(batch.column(kept)[r].values.to_numpy(zero_copy_only=False), batch.column(kept + 1)[r].as_py(), batch.column(kept + 2)[r].as_py())
                for r in range(count)
            ]
            row = np.repeat(np.arange(count), [len(x) for x in each])
            window = np.concatenate([np.arange(len(x)) for x in each]) if each else np.zeros(0, np.int64)
            sizes = batch.column(kept + 2).to_numpy(zero_copy_only=False).astype(np.int64)
            levels = np.concatenate(each) if each else np.zeros(0, np.float32)
            columns = [batch.column(k).take(pa.array(row)) for k in range(kept)]
            columns += [pa.array(window.astype(np.int64)), pa.array(levels), pa.array((window + 1) * sizes[row])]
            yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    found = sized.mapInArrow(run, out)
    return found.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)], "window_idx", "rms", dbfs(F.col("rms").cast("double")).cast("float").alias("dbfs"), "end_frame"
    )
