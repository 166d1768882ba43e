"""16-bit PCM WAV files: written by tasks, read in Arrow batches."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WAV = T.StructType([T.StructField("samples", T.ArrayType(T.ShortType())), T.StructField("sample_rate_hz", T.IntegerType()), T.StructField("channels", T.IntegerType())])


def encode(samples: np.ndarray, rate: int, channels: int) -> bytes:
    """WAV bytes of interleaved 16-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def decode(content: bytes) -> tuple[np.ndarray, int, int]:
    with wave.open(io.BytesIO(content), "rb") as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is supported")
        return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.int16), w.getframerate(), w.getnchannels()


@F.pandas_udf(T.BinaryType())
def wav_bytes(samples: pd.Series, rate: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else encode(s, int(r), int(c)) for s, r, c in zip(samples, rate, channels)])


@F.pandas_udf(WAV)
def wav_samples(content: pd.Series) -> pd.DataFrame:
    rows = [decode(c) for c in content]
    return pd.DataFrame({"samples": [r[0] for r in rows], "sample_rate_hz": [r[1] for r in rows], "channels": [r[2] for r in rows]})


def write_wavs(recordings: DataFrame, root: str, name: str = "id") -> DataFrame:
    """Write <root>/audio/<name>.wav for each recording and return name and audio_path.

    The root is a path or a URI of a file system that tasks reach (a shared mount, hdfs, s3, gs); a file is written under a
    name of its own first and moved, so a repeated task leaves whole files.
    """

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        folder = f"{base.rstrip('/')}/audio"
        files.create_dir(folder, recursive=True)
        for batch in batches:
            paths = []
            for key, samples, rate, channels in zip(batch["name"], batch["samples"], batch["rate"], batch["channels"]):
                path = f"{folder}/{key}.wav"
                part = f"{path}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as f:
                    f.write(encode(samples, int(rate), int(channels)))
                files.move(part, path)
                paths.append(f"audio/{key}.wav")
            yield pd.DataFrame({"id": batch["name"], "audio_path": paths})

    slim = recordings.select(F.col(name).alias("name"), "samples", F.col("sample_rate_hz").alias("rate"), "channels")
    return slim.mapInPandas(save, "id string, audio_path string")


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """path, samples, sample_rate_hz and channels of WAV files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", wav_samples("content").alias("w")).select("path", "w.*")


def file_name(key: Column) -> Column:
    return F.concat(F.lit("audio/"), key, F.lit(".wav"))
