"""The detector within one session in parallel: chunks from guessed states, repaired until the states agree.

A session is cut into chunks of windows. Every chunk begins in a state that a new detector comes to over the chunk before it, and
gives its events and the state at its end. A guess was right if it is the state at the end of the chunk before; where it was not,
the chunk is run again from that state. When all agree, the first chunk of a session began as a new detector and every other one
where the one before it ended, so the events are those of the fold over the whole session. Noise floors forget where they came
from within some thousand quiet windows, so with long chunks a few chunks are run again. While a round halves the wrong guesses at
least, the next one is run in the same way. Where it doesn't (chunks are too short to forget in), the last round reads each such
session in order from its first wrong chunk on, as the fold does. So there are at most as many rounds as bits in the number of chunks.

A task reads the rows of its chunks in order, a batch at a time, with the detector carried over batches.

Utterances are numbered within chunks and shifted by those that ended in the chunks before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from utterscope.operators.vad import COLUMNS, EVENTS, Detector, VadConfig, frame_of, level_columns
from utterscope.sources.scratch import new_path

CHUNK = 100_000
STATES = "entry string, exit string, ended bigint"


def _told(d: Detector) -> str:
    """A detector's state as text; equal states have equal texts."""
    parts = [np.array([d.floor is not None, d.speaking]), np.array([d.floor or 0.0]), d.windows, d.levels, d.frames]
    return ":".join(p.tobytes().hex() for p in parts)


def _resumed(state: str, config: VadConfig) -> Detector:
    flags, floor, *rest = [np.frombuffer(bytes.fromhex(x), kind) for x, kind in zip(state.split(":"), (bool, np.float64, np.int64, np.float32, np.int64))]
    return Detector(config, 0, float(floor[0]) if flags[0] else None, bool(flags[1]), *rest)


def _chunks(batches: Iterator[pd.DataFrame], config: VadConfig, carry: bool) -> Iterator[pd.DataFrame]:
    """Events of chunks, and a row of states for each. A chunk's rows are in order: a given state (a row without a window), if there
    is one, rows of the chunk before as a warm-up, and its own. With `carry`, a chunk goes on from the chunk before it.
    """
    now, detector, entry = None, Detector(config), None
    for batch in batches:
        found: list[dict] = []
        session, chunk, given, window, dbfs, frame, own = (batch[c].to_numpy() for c in ("session", "chunk", "given", "window_idx", "dbfs", "end_frame", "own"))
        cuts = np.flatnonzero((session[1:] != session[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)] if len(batch) else []):
            key = (session[a], int(chunk[a]))
            if key != now:
                if now is not None:
                    found.append({"session": now[0], "chunk": now[1], "entry": entry, "exit": _told(detector), "ended": detector.utterance})
                if not (carry and now is not None and now[0] == key[0]):
                    detector = Detector(config)
                now, entry = key, None
            if given[a] is not None:
                detector, a = _resumed(given[a], config), a + 1
            first = a + int(np.searchsorted(own[a:b], True))
            if first > a:
                detector.feed(window[a:first], dbfs[a:first], frame[a:first])
            if first < b:
                if entry is None:
                    detector.utterance = 0
                    entry = _told(detector)
                events = detector.feed(window[first:b], dbfs[first:b], frame[first:b])
                found += [{"session": key[0], "chunk": key[1], **e} for e in events]
        yield _frame(found)
    if now is not None:
        yield _frame([{"session": now[0], "chunk": now[1], "entry": entry, "exit": _told(detector), "ended": detector.utterance}])


def _frame(found: list[dict]) -> pd.DataFrame:
    frame = frame_of(found, ["session", "chunk", *COLUMNS, "entry", "exit", "ended"])
    counts, texts = ["utterance", "window_idx", "at_frame", "ended"], ["entry", "exit"]
    frame[counts] = frame[counts].astype("Int64")
    frame[texts] = frame[texts].astype(object).where(frame[texts].notna(), None)
    return frame


def detect_long(levels: DataFrame, session: str = "session", config: VadConfig | None = None, chunk: int = CHUNK) -> DataFrame:
    """The events of operators.vad.detect, whose sessions may be of any length; chunks have `chunk` window numbers."""
    config = config or VadConfig()
    spark = levels.sparkSession
    slim = level_columns(levels.where(F.col(session).isNotNull()), session).withColumn("chunk", F.floor(F.col("window_idx") / chunk).cast("bigint"))
    kind = slim.schema["session"].dataType.simpleString()
    schema = f"session {kind}, chunk bigint, {EVENTS}, {STATES}"
    none = F.lit(None).cast("string").alias("given")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        path = new_path(spark, name)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def run(rows: DataFrame, keys: list[str], carry: bool) -> DataFrame:
        dealt = rows.select("session", "chunk", "given", "window_idx", "dbfs", "end_frame", "own").repartition(*keys)
        ordered = dealt.sortWithinPartitions("session", "chunk", F.col("window_idx").asc_nulls_first())
        return stored(ordered.mapInPandas(partial(_chunks, config=config, carry=carry), schema), "chunks")

    def from_states(own: DataFrame, given: DataFrame) -> DataFrame:
        """Own rows, and a row of each given state, which comes first in its chunk."""
        first = given.select("session", "chunk", "given", *[F.lit(0).cast(slim.schema[c].dataType).alias(c) for c in ("dbfs", "end_frame")], F.lit(False).alias("own"))
        return own.select("*", none, F.lit(True).alias("own")).unionByName(first.withColumn("window_idx", F.lit(None).cast("bigint")))

    slim = stored(slim, "levels")
    before = Window.partitionBy("session").orderBy("chunk")
    follow = slim.select("session", "chunk").distinct().withColumn("next", F.lead("chunk").over(before))  # a session's chunks, not its windows
    places = F.array(F.struct("chunk", F.lit(True).alias("own")), F.struct(F.col("next").alias("chunk"), F.lit(False).alias("own")))
    both = slim.join(follow, ["session", "chunk"]).withColumn("place", F.explode(places)).drop("chunk", "next").select("*", "place.*").drop("place")
    found, last = run(both.where("chunk is not null").select("*", none), ["session", "chunk"], False), None
    while True:
        states = found.where("entry is not null").select("session", "chunk", "entry", "exit")
        wrong = states.withColumn("given", F.lag("exit").over(before)).where("given is not null and entry <> given").select("session", "chunk", "given")
        wrong = stored(wrong, "wrong")
        count = wrong.count()
        if not count:
            break
        if last is None or 2 * count <= last:
            again = run(from_states(slim.join(wrong, ["session", "chunk"], "left_semi"), wrong), ["session", "chunk"], False)
            kept = found.join(wrong, ["session", "chunk"], "left_anti")
        else:
            first = wrong.groupBy("session").agg(F.min(F.struct("chunk", "given")).alias("first")).select("session", F.col("first.chunk").alias("from"), "first.given")
            first = stored(first, "first")
            rest = slim.join(first.select("session", "from"), "session").where(F.col("chunk") >= F.col("from")).drop("from")
            again = run(from_states(rest, first.withColumnRenamed("from", "chunk")), ["session"], True)
            kept = found.join(first.select("session", "from"), "session", "left").where("from is null or chunk < from").drop("from")
        found, last = stored(kept.unionByName(again), "chunks"), count
    ended = F.coalesce(F.sum("ended").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = found.where("entry is not null").select("session", "chunk", ended.alias("shift"))
    events = found.where("entry is null").join(shift, ["session", "chunk"])
    return events.withColumn("utterance", F.col("utterance") + F.col("shift")).select("session", *COLUMNS)
