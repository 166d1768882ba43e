"""Levels of windows in a stream: chunks of samples in, a row for every whole window out.

The samples of the window that a batch leaves open are the session's state, so any split of a recording into chunks and of
chunks into batches gives the levels of the whole. Windows begin at multiples of their size; a window of which frames are
missing is left out, and so is the tail of a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.functions.audio import WINDOW_SECONDS, dbfs, frames_for
from utterscope.operators.levels import window_levels
from utterscope.streaming.state import ENDED, SessionProcessor, with_state

LEVELS = "session string, window_idx bigint, rms float, end_frame bigint"


def _joined(frames: np.ndarray, chunks: np.ndarray, tail: np.ndarray, tail_frame: int, channels: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first frame, samples) of the stretches without gaps of the tail and the chunks, overlaps left out."""
    start, parts, upto = tail_frame, [tail], tail_frame + len(tail) // channels
    for frame, samples in zip(frames.tolist(), chunks):
        own = np.asarray(samples, np.int16)
        if frame > upto:
            yield start, np.concatenate(parts)
            start, parts, upto = frame, [], frame
        own = own[(upto - frame) * channels :]
        parts.append(own)
        upto += len(own) // channels
    yield start, np.concatenate([*parts, np.zeros(0, np.int16)])


class LevelProcessor(SessionProcessor):
    HEAD = "last_chunk bigint, tail_frame bigint"
    ITEM = "samples array<int>"
    POSITION = "start_frame"

    def take(self, session: str | None, rows: dict[str, np.ndarray]) -> list[tuple]:
        """(session, first window, size, levels) of each stretch."""
        head = self.head.get()
        last, tail_frame = head if head else (None, None)
        kept = self.items.get() if head else None
        tail = np.array(kept[0] if kept else [], np.int16)
        new = self.since(rows, last)
        there = np.array([x is not None for x in new["samples"]], bool) & (new["channels"] > 0) & (new["size"] > 0)
        found = []
        if there.any():
            frames, chunks = new["start_frame"][there], new["samples"][there]
            channels, size = int(new["channels"][there][0]), int(new["size"][there][0])
            for first, samples in _joined(frames, chunks, tail, int(frames[0]) if tail_frame is None else tail_frame, channels):
                skip = -first % size
                samples, first = samples[skip * channels :], int(first) + skip
                rms = window_levels(samples, channels, size)
                found.append((session, first // size, size, rms))
                tail, tail_frame = samples[len(rms) * size * channels :], first + len(rms) * size
            # a gap that begins within a window leaves its rest out: the tail then begins at the next window
        if new[ENDED].any():
            self.head.clear()
            self.items.clear()
        elif len(new["start_frame"]):
            self.head.update((int(new["start_frame"][-1]), None if tail_frame is None else int(tail_frame)))
            if len(tail):
                self.items.put((tail.tolist(),))
            elif kept:
                self.items.clear()
        return found

    def out(self, found: list[tuple]) -> pd.DataFrame:
        window = np.concatenate([np.zeros(0, np.int64), *[first + np.arange(len(rms)) for _, first, _, rms in found]])
        count = [len(rms) for *_, rms in found]
        names = np.repeat(np.array([name for name, *_ in found], object), count)
        size = np.repeat(np.array([size for _, _, size, _ in found], np.int64), count)
        rms = np.concatenate([np.zeros(0, np.float32), *[rms for *_, rms in found]])
        return pd.DataFrame({"session": pd.Series(names, dtype=object), "window_idx": window, "rms": rms, "end_frame": (window + 1) * size})


def levels_stream(chunks: DataFrame, seconds: float = WINDOW_SECONDS, idle_ms: int | None = None) -> DataFrame:
    """session, window_idx, rms, dbfs and end_frame from session, start_frame, samples, sample_rate_hz and channels."""
    ended = F.coalesce(F.col(ENDED), F.lit(False)) if ENDED in chunks.columns else F.lit(False)
    slim = chunks.select(
        F.col("session").cast("string").alias("session"), F.col("start_frame").cast("bigint").alias("start_frame"), "samples",
        F.col("channels").cast("int").alias("channels"), frames_for(F.col("sample_rate_hz"), seconds).cast("int").alias("size"), ended.alias(ENDED),
    )
    found = with_state(slim, LevelProcessor(idle_ms), LEVELS)
    level = dbfs(F.col("rms").cast("double")).cast("float").alias("dbfs")
    return found.select("session", "window_idx", "rms", level, "end_frame")
