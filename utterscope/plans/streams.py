"""Named queries over streams, each with its SQL: what a batch of the same rows gives.

Each stream reads a table in three runs, in the order of its rows, so that state is carried over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterscope.functions import audio
from utterscope.operators import process
from utterscope.plans import adapter, oracles, roundtrips
from utterscope.plans.queries import SMALL, _frames, with_timer_slots
from utterscope.sources import recordings, wav
from utterscope.sources.scratch import new_path
from utterscope.streaming.capture import CAPTURES, capture_stream
from utterscope.streaming.level_stream import levels_stream
from utterscope.streaming.timers import ELAPSED, elapsed_stream
from utterscope.streaming.vad_stream import append_stream, detect_stream

PARTS = 3


def table_of(rows: DataFrame, order: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that `make` appends to a table from a stream of `rows`: PARTS runs of a query that go on from one another, each
    of a range of `order`. The rows are stored once and written by many tasks, so no task has a whole range.
    """
    spark = rows.sparkSession
    root = new_path(spark, "stream")
    rows.write.parquet(f"{root}/rows")
    kept = spark.read.schema(rows.schema).parquet(f"{root}/rows")
    low, high = kept.agg(F.min(order), F.max(order)).first()
    place = F.floor((F.col(order) - low) * PARTS / (high - low + 1)) if low is not None else F.lit(0)
    for part in range(PARTS):
        kept.where(place == part).write.mode("append").parquet(f"{root}/in")
        stream = make(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
        append_stream(stream, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


def _wavs(spark: SparkSession, sf_dir: str) -> str | None:
    """A folder of WAV files of all recordings."""
    root = new_path(spark, "wav")
    written = wav.write_wavs(roundtrips._recordings(spark, sf_dir), root).agg(F.count(F.lit(1))).first()[0]
    return f"{root}/audio" if written else None


def _rounded_levels(found: DataFrame) -> DataFrame:
    level = audio.meter(F.round(F.col("dbfs").cast("double"), 0)).alias("meter")
    return found.select(F.col("session").alias("id"), "window_idx", F.round(F.col("rms").cast("double"), 4).alias("rms"), "end_frame", level)


_NO_LEVELS = "id string, window_idx bigint, rms double, end_frame bigint, meter string"


def wav_piece_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of recordings that are read from WAV files by pieces of two windows, over splits of 64 bytes."""
    path = _wavs(spark, sf_dir)
    if path is None:
        return spark.createDataFrame([], _NO_LEVELS)
    return _rounded_levels(recordings.levels_of_pieces(recordings.read_pieces(spark, path, pieceWindows=2, splitBytes=64)))


def wav_stream_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the files' frames: three runs of a query, each of up to 43 frames of each recording (a window
    has 10), that go on from one another; a file has fewer than 129 frames.
    """
    path = _wavs(spark, sf_dir)
    if path is None:
        return spark.createDataFrame([], _NO_LEVELS)
    sink = new_path(spark, "stream")
    for _ in range(3):
        found = levels_stream(recordings.stream_pieces(spark, path, maxFrames=43, pieceWindows=1, progress=f"{sink}/progress.json"))
        append_stream(found, f"{sink}/table", f"{sink}/checkpoint").awaitTermination()
    return _rounded_levels(spark.read.schema(found.schema).parquet(f"{sink}/table"))


def wav_stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector events of the users' frames: from chunks of samples in a stream to levels, and from these to events."""
    frames = _frames(spark, sf_dir).select("session", "frame", "x")
    chunk = F.floor(F.col("frame") / 7)
    one = F.struct("frame", audio.i16_from_float(F.col("x")).alias("s"))
    chunks = frames.groupBy("session", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    rows = chunks.select(
        "session", (F.col("chunk") * 7).alias("start_frame"), F.transform("x", lambda x: x["s"]).alias("samples"),
        F.lit(100).alias("sample_rate_hz"), F.lit(1).alias("channels"),
    )
    levels = table_of(rows, "start_frame", levels_stream).select("session", "window_idx", "dbfs", "end_frame")
    return table_of(levels, "window_idx", lambda x: detect_stream(x, SMALL)).select(
        "session", "utterance", "event", "window_idx", "at_frame", "end_reason", "speech_windows", "silence_windows"
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a capture gate a user hands out: sign-ups begin, purchases finish, errors pause or cancel, other events are chunks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    command = F.when(kind == "signup", "begin").when(kind == "purchase", "finish").when(kind == "error", F.when(F.col("event_id") % 2 == 0, "pause").otherwise("cancel"))
    sample = F.floor(F.col("value")).cast("smallint")
    samples = F.when(kind.isin("view", "click"), F.array(sample, (-sample).cast("smallint"), F.lit(1).cast("smallint")))
    rows = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("place"), command.alias("command"), samples.alias("samples"))
    found = table_of(rows, "place", capture_stream)
    total = F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, s: a + s.cast("bigint") * s)
    return found.select("session", "finished_at", "began_at", "n_samples", total.alias("squares"))


def timers_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timers that have fired when the events have been seen: those due before the last event's moment."""
    events = adapter.events(spark, sf_dir).select("id", F.col("moment").cast("timestamp").alias("moment"), "timestamp", "transcript", "execution_result")
    cores = spark.sparkContext.defaultParallelism  # a batch is few files, and phrases cost more than their bytes

    def seen(stream: DataFrame) -> DataFrame:
        told = stream.withWatermark("moment", "0 seconds").repartition(cores)
        return elapsed_stream(process.timers(with_timer_slots(told), clock="moment"))

    fired = table_of(events.withColumn("second", F.unix_timestamp("moment")), "second", seen)
    return fired.select("event_id", "duration_seconds", F.unix_timestamp("fire_at").alias("fire_at"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "wav_piece_levels": wav_piece_levels, "wav_stream_levels": wav_stream_levels, "wav_stream_events": wav_stream_events,
    "captures": captures, "timers_elapsed": timers_elapsed,
}

_I16 = roundtrips._I16.format("x")

ORACLES: dict[str, str] = {
    "wav_piece_levels": roundtrips.ORACLES["recording_levels"],
    "wav_stream_levels": roundtrips.ORACLES["recording_levels"],
    "wav_stream_events": oracles.vad_run(f"CAST({_I16} AS DOUBLE) / 32768") + """
SELECT session, utterance, event, window_idx, at_frame, end_reason, speech_windows, silence_windows FROM told""",
    "captures": """WITH rows AS (
  SELECT CAST(user_id AS VARCHAR) AS session, event_id AS place, event_type AS kind, CAST(floor(value) AS BIGINT) AS v FROM events),
commands AS (
  SELECT session, place, kind, lag(kind) OVER w AS before, lag(place) OVER w AS began FROM rows WHERE kind IN ('signup', 'purchase', 'error')
  WINDOW w AS (PARTITION BY session ORDER BY place)),
done AS (SELECT session, place AS finished_at, CASE WHEN before = 'signup' THEN began END AS began_at FROM commands WHERE kind = 'purchase')
SELECT d.session, finished_at, began_at, CASE WHEN began_at IS NOT NULL THEN 3 * count(v) END AS n_samples,
  CASE WHEN began_at IS NOT NULL THEN CAST(coalesce(sum(2 * v * v + 1), 0) AS BIGINT) END AS squares
FROM done d LEFT JOIN rows r ON r.session = d.session AND r.place > began_at AND r.place < finished_at AND r.kind IN ('view', 'click')
GROUP BY d.session, finished_at, began_at""",
    "timers_elapsed": oracles._with("""SELECT id AS event_id, CAST(seconds AS BIGINT) AS duration_seconds, CAST(floor(epoch(ts)) AS BIGINT) + seconds AS fire_at
FROM ev WHERE transcript IS NOT NULL AND seconds IS NOT NULL AND status = 'succeeded' AND (CAST(floor(epoch(ts)) AS BIGINT) + seconds) * 1000 <= (SELECT max(epoch_ms(ts)) FROM ev)"""),
}
