"""The detector in Structured Streaming: typed state a session, rows of a batch in window order.

Windows at or before the last one seen of a session are dropped, so a repeated batch changes nothing. The state is the noise
floor and the windows of the open phase, of which there are at most as many as the longest wait or speech. A session's
windows of one micro-batch (32 bytes each) are sorted in memory; the source's limit a trigger (`maxFilesPerTrigger`) bounds
them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from utterscope.operators.vad import COLUMNS, EVENTS, Detector, VadConfig, frame_of, level_columns
from utterscope.streaming.state import ENDED, SessionProcessor, with_state


class VadProcessor(SessionProcessor):
    HEAD = "utterance bigint, floor double, speaking boolean, last_window bigint"
    ITEM = "window_idx array<bigint>, dbfs array<float>, end_frame array<bigint>"
    POSITION = "window_idx"

    def __init__(self, config: VadConfig, idle_ms: int | None = None) -> None:
        super().__init__(idle_ms)
        self.config = config

    def _detector(self) -> tuple[Detector, int | None]:
        head = self.head.get()
        if head is None:
            return Detector(self.config), None
        utterance, floor, speaking, last = head
        kept = self.items.get() or ([], [], [])
        columns = [np.array(x, kind) for x, kind in zip(kept, (np.int64, np.float32, np.int64))]
        return Detector(self.config, utterance, floor, speaking, *columns), last

    def take(self, session: str | None, rows: dict[str, np.ndarray]) -> list[dict]:
        detector, last = self._detector()
        before = len(detector.windows)
        new = self.since(rows, last)
        heard = ~np.isnan(new["dbfs"])
        found = detector.feed(*(new[c][heard] for c in ("window_idx", "dbfs", "end_frame")))
        if new[ENDED].any():
            self.head.clear()
            self.items.clear()
        elif len(heard):
            self.head.update((detector.utterance, detector.floor, detector.speaking, int(new["window_idx"][-1])))
            if len(detector.windows):
                self.items.put((detector.windows.tolist(), detector.levels.tolist(), detector.frames.tolist()))
            elif before:
                self.items.clear()
        return [{"session": session, **e} for e in found]

    def out(self, found: list[dict]) -> pd.DataFrame:
        return frame_of(found, ["session", *COLUMNS])


def detect_stream(levels: DataFrame, config: VadConfig | None = None, idle_ms: int | None = None) -> DataFrame:
    """The batch detector's events from a stream of session (string), window_idx, dbfs and end_frame.

    A row whose boolean `session_ended`, if there is such a column, is true ends its session (its level may be null); so does
    silence of `idle_ms` milliseconds of processing time. What comes later is a new session. With an idle time the engine looks
    for what has expired in batches without rows, so such a query runs until it is stopped: it needs a processing-time trigger.
    """
    ended = F.coalesce(F.col(ENDED), F.lit(False)) if ENDED in levels.columns else F.lit(False)
    slim = level_columns(levels.withColumn("session", F.col("session").cast("string")).withColumn(ENDED, ended), "session", ENDED)
    return with_state(slim, VadProcessor(config or VadConfig(), idle_ms), f"session string, {EVENTS}")


def append_stream(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to Parquet, each batch once."""
    written = events.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return written.trigger(**(trigger or {"availableNow": True})).start()
