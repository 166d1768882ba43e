"""Stateful processors keyed by session: what they share.

A call of the engine's Python protocol costs some milliseconds, and sessions are many and short. So sessions are dealt to LANES by
a hash, and a call takes the rows of a lane's sessions. State is still that of a session: entries of maps that only sessions with
rows read and write. LANES is part of a checkpoint's layout.

State is kept in typed columns by the RocksDB provider, in a format that lets later versions of a processor add fields. It ends
with its session: a row that says so clears it, and sessions that fall silent are forgotten after an idle time, if one is given.
Rows of a session must come in order of their positions over micro-batches; within a batch they are sorted. Positions that were
seen are left out, so a repeated row changes nothing. A lane's rows of one batch come to memory together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of a row that ends its session, if a stream has such a column.
ENDED = "session_ended"
LANES = 1024


def use_state(spark: SparkSession, encoding: str = "avro") -> None:
    """What processors (or, by `unsaferow`, an engine's aggregates) need of a session; set as a stream is made, so start a query
    before another one is made."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.encodingFormat", encoding)


def by_session(rows: pd.DataFrame, position: str) -> Iterator[tuple[str | None, dict[str, np.ndarray]]]:
    """Each session with its columns in order, without repeated positions."""
    codes, names = pd.factorize(rows["session"], use_na_sentinel=False)
    order = np.lexsort((rows[position].to_numpy(), codes))
    codes = codes[order]
    columns = {c: rows[c].to_numpy()[order] for c in rows.columns if c not in ("session", "lane")}
    new = np.append(True, (codes[1:] != codes[:-1]) | (columns[position][1:] != columns[position][:-1]))
    codes, columns = codes[new], {c: x[new] for c, x in columns.items()}
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)]):
        name = names[codes[a]]
        yield None if pd.isna(name) else name, {c: x[a:b] for c, x in columns.items()}


class SessionHead:
    """The value of a session."""

    def __init__(self, values: MapState, session: str | None) -> None:
        self.values, self.session = values, session

    def exists(self) -> bool:
        return self.values.containsKey((self.session,))

    def get(self) -> tuple | None:
        return self.values.getValue((self.session,))

    def update(self, value: tuple) -> None:
        self.values.updateValue((self.session,), value)

    def clear(self) -> None:
        self.values.removeKey((self.session,))


class SessionItems:
    """The numbered parts of what a session holds; each is read and written on its own."""

    def __init__(self, parts: MapState, session: str | None) -> None:
        self.parts, self.session = parts, session

    def get(self, part: int = 0) -> tuple | None:
        return self.parts.getValue((self.session, part))

    def put(self, value: tuple, part: int = 0) -> None:
        self.parts.updateValue((self.session, part), value)

    def clear(self, count: int = 1) -> None:
        for part in range(count):
            self.parts.removeKey((self.session, part))


class SessionProcessor(StatefulProcessor):
    """A processor whose sessions have `head`, a value of the fields HEAD, and `items`, parts of the fields ITEM.

    `take` gets a session's name and its new rows by POSITION and returns what goes out, `out` makes a frame of all that.
    """

    HEAD = ""
    ITEM = ""
    POSITION = ""

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getMapState("heads", "session string", self.HEAD, self.idle_ms)
        self.parts = handle.getMapState("parts", "session string, part bigint", self.ITEM, self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found: list = []
        for session, columns in by_session(pd.concat(list(rows)), self.POSITION):
            self.head, self.items = SessionHead(self.heads, session), SessionItems(self.parts, session)
            found += self.take(session, columns)
        yield self.out(found)

    def take(self, session: str | None, rows: dict[str, np.ndarray]) -> list:
        raise NotImplementedError

    def out(self, found: list) -> pd.DataFrame:
        raise NotImplementedError

    def since(self, rows: dict[str, np.ndarray], last: int | None) -> dict[str, np.ndarray]:
        """The rows after the last position seen."""
        if last is None or rows[self.POSITION][0] > last:
            return rows
        at = int(np.searchsorted(rows[self.POSITION], last, "right"))
        return {c: x[at:] for c, x in rows.items()}

    def close(self) -> None:
        pass


def with_state(rows: DataFrame, processor: SessionProcessor, schema: str) -> DataFrame:
    """The rows that a processor makes of a stream's sessions."""
    use_state(rows.sparkSession)
    mode = "None" if processor.idle_ms is None else "ProcessingTime"
    lane = F.pmod(F.xxhash64("session"), F.lit(LANES)).cast("int")
    return rows.withColumn("lane", lane).groupBy("lane").transformWithStateInPandas(processor, schema, "append", mode)
