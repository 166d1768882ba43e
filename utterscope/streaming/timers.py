"""Timers that fire: each timer that events set, once, when event time has passed its moment.

A timer is a session window of its event: it opens at the event's moment, its gap is what is left until the timer is due, and it
closes, after a restart too, when the watermark has passed its end. So timers are rows of an engine's aggregate, not calls of a
function each, and state goes when they have fired. A timer whose event is repeated is the same window, so it is set once;
repetitions after it has fired are late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.streaming.state import use_state

ELAPSED = "event_id string, duration_seconds bigint, fire_at timestamp"


def elapsed_stream(timers: DataFrame) -> DataFrame:
    """event_id, duration_seconds and fire_at of the timers that have fired.

    `timers` is a stream of these columns (operators.process.timers makes them of events) and of `moment`, the event time on
    which the caller has set the watermark. Moments are kept in milliseconds. A timer that is due at its event's moment or before
    fires when event time has passed that moment.
    """
    use_state(timers.sparkSession, "unsaferow")
    due = (F.floor(F.unix_micros("fire_at") / 1000) * 1000).cast("bigint")
    slim = timers.select("event_id", "duration_seconds", due.alias("due"), "moment")
    slim = slim.where(F.when(F.col("moment").isNotNull(), F.col("due").isNotNull()))  # as in process.timers: the watermark sees all moments
    gap = F.concat(F.greatest(F.col("due") - F.unix_micros("moment"), F.lit(1)).cast("string"), F.lit(" microseconds"))
    first = F.min(F.struct("due", "duration_seconds")).alias("first")
    fired = slim.groupBy("event_id", F.session_window("moment", gap)).agg(first)
    return fired.select("event_id", F.col("first.duration_seconds").alias("duration_seconds"), F.timestamp_micros("first.due").alias("fire_at"))
