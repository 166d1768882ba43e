"""The capture gate: commands and chunks of samples in one order, finished captures out.

`begin` starts a capture anew and drops what was held; `pause` and `cancel` drop it and close the gate; `finish` hands out the
samples since `begin` and closes the gate. Chunks that come while the gate is closed are dropped, and a `finish` then hands out
a row without samples, as there is nothing to finish.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.streaming.state import ENDED, SessionProcessor, with_state

COMMANDS = ("begin", "pause", "cancel", "finish")
CAPTURES = "session string, finished_at bigint, began_at bigint, n_samples bigint, samples array<smallint>"


class CaptureGate(SessionProcessor):
    HEAD = "last_place bigint, began_at bigint, n_parts bigint"
    ITEM = "samples array<int>"
    POSITION = "place"

    def take(self, session: str | None, rows: dict[str, np.ndarray]) -> list[tuple]:
        head = self.head.get()
        last, began, parts = head if head else (None, None, 0)
        new = self.since(rows, last)
        held: list[np.ndarray] = []  # of this batch; those of earlier ones stay in the state until asked for
        fresh, found = began is None, []
        for place, command, samples in zip(new["place"].tolist(), new["command"].tolist(), new["samples"].tolist()):
            if command is None:
                if began is not None and samples is not None:
                    held.append(samples)
            elif command == "finish":
                whole = None
                if began is not None:
                    kept = [] if fresh else [self.items.get(k)[0] for k in range(parts)]
                    whole = np.concatenate([np.zeros(0, np.int16), *kept, *held]).astype(np.int16)
                found.append((session, place, began, None if whole is None else len(whole), whole))
                began, held, fresh = None, [], True
            elif command in COMMANDS:
                began, held, fresh = (place if command == "begin" else None), [], True
        ended = bool(new[ENDED].any())
        if fresh or ended:
            self.items.clear(parts)
            parts = 0
        if ended:
            self.head.clear()
        elif len(new["place"]):
            if held:
                self.items.put((np.concatenate(held).tolist(),), parts)
                parts += 1
            self.head.update((int(new["place"][-1]), began, parts))
        return found

    def out(self, found: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(found, columns=["session", "finished_at", "began_at", "n_samples", "samples"])
        return frame.astype({"session": object, "finished_at": "int64", "began_at": "Int64", "n_samples": "Int64", "samples": object})


def capture_stream(rows: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """CAPTURES of a stream of session, place (the order), command (null for a chunk) and samples (of a chunk)."""
    ended = F.coalesce(F.col(ENDED), F.lit(False)) if ENDED in rows.columns else F.lit(False)
    slim = rows.select(
        F.col("session").cast("string").alias("session"), F.col("place").cast("bigint").alias("place"), F.col("command").cast("string").alias("command"),
        F.col("samples").cast("array<smallint>").alias("samples"), ended.alias(ENDED),
    )
    return with_state(slim, CaptureGate(idle_ms), CAPTURES)
