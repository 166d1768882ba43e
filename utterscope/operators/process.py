"""From captured utterances to events: the short gate, the command, its result and its timer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.functions.intent import slots, with_intent
from utterscope.functions.spoken import response
from utterscope.functions.text import file_stem
from utterscope.schema import EVENT_VERSION
from utterscope.sources.wav import file_name

MIN_SPEECH_MS = 140
WINDOW_MS = 20


def has_minimum_speech(speech_windows: Column, window_ms: int = WINDOW_MS, least_ms: int = MIN_SPEECH_MS) -> Column:
    return F.coalesce(speech_windows >= -(-least_ms // window_ms), F.lit(False))


def execution_status(intent: Column, long_enough: Column, prompted: Column, transcribed: Column, failed: Column) -> Column:
    """What became of an utterance; the first that holds of: too short, not transcribed, non-speech, prompted, failed, done."""
    return (
        F.when(~long_enough, "rejected")
        .when(~transcribed, "not_attempted")
        .when(intent == "no_speech", "rejected")
        .when(prompted, "not_attempted")
        .when(failed, "failed")
        .when(intent == "unknown", "unsupported")
        .otherwise("succeeded")
    )


def telemetry(segments: DataFrame, rate: Column, start: Column, end: Column, window_ms: int = WINDOW_MS) -> DataFrame:
    """Add `vad`, the event log's telemetry, to detector segments; the duration is that of the slice, pre-roll included."""
    names = ("noise_floor_dbfs", "start_threshold_dbfs", "end_threshold_dbfs", "peak_dbfs", "mean_speech_dbfs", "median_speech_dbfs")
    duration = F.round((end - start).cast("double") * 1000 / rate).cast("bigint")
    return segments.withColumn(
        "vad",
        F.struct(*[F.col(n) for n in names], duration.alias("duration_ms"), (F.col("trailing_silence_windows") * window_ms).alias("trailing_silence_ms"), "speech_windows", "silence_windows", "end_reason"),
    )


def build_events(captured: DataFrame) -> DataFrame:
    """Events of captured utterances.

    `captured` has id_time (RFC 3339), id_suffix, provenance, collection, device, sample_rate_hz, channels, transcript,
    processing_error, action_error, vad and moment. Short utterances have neither audio nor transcript.
    """
    long_enough = has_minimum_speech(F.col("vad.speech_windows"))
    heard = captured.withColumn("transcript", F.when(long_enough & F.col("processing_error").isNull(), F.col("transcript")))
    parsed = with_intent(heard, "transcript", "__intent", "__seconds")
    intent, prompted = F.col("__intent"), F.col("collection").isNotNull()
    failed = F.col("action_error").isNotNull()
    status = execution_status(intent, long_enough, prompted, F.col("transcript").isNotNull(), failed)
    identity = F.concat_ws("-", file_stem(F.col("id_time")), "id_suffix")
    acted = status.isin("succeeded", "unsupported")
    return parsed.select(
        F.lit(EVENT_VERSION).cast("smallint").alias("schema_version"), identity.alias("id"), F.col("id_time").alias("timestamp"), "provenance", "collection",
        F.when(long_enough, file_name(identity)).alias("audio_path"),
        F.struct("device", "sample_rate_hz", "channels").alias("input"), "transcript",
        F.when(intent.isNotNull(), F.struct(intent.alias("intent"), slots(intent, F.col("__seconds")).alias("slots"))).alias("prediction"),
        F.struct(status.alias("status"), F.when(acted, response(intent, F.col("__seconds"), F.col("moment"))).alias("response"), F.when(status == "failed", F.col("action_error")).alias("error")).alias("execution_result"),
        F.coalesce("processing_error", F.when(status == "failed", F.col("action_error"))).alias("processing_error"), "vad",
    )


def timers(events: DataFrame, clock: str | None = None) -> DataFrame:
    """event_id, duration_seconds and fire_at of the timers that events have set.

    With `clock`, a column of event time, it is kept, and events without a timer are left out by a test that names it: so a
    stream's watermark sees the moments of all events.
    """
    seconds = F.col("prediction.slots")["duration_seconds"].cast("bigint")
    started = (F.col("prediction.intent") == "set_timer") & (F.col("execution_result.status") == "succeeded")
    at = F.to_timestamp("timestamp")
    due = F.timestamp_seconds(F.unix_micros(at) / 1_000_000 + seconds).alias("fire_at")
    kept = events.where(F.when(F.col(clock).isNotNull(), started) if clock else started)
    return kept.select(F.col("id").alias("event_id"), seconds.alias("duration_seconds"), due, *([clock] if clock else []))


_models: dict[tuple[str, str], Callable] = {}


def loaded(load: Callable[[], Callable]) -> Callable:
    """The model that `load` gives, loaded once a worker process."""
    key = (load.__module__, load.__qualname__)
    if key not in _models:
        _models[key] = load()
    return _models[key]


def transcribe(recordings: DataFrame, model: Callable | None = None, columns: tuple[str, ...] = ("id",), load: Callable[[], Callable] | None = None) -> DataFrame:
    """Add `transcript` by a speech model: a function from samples (mono floats at 16 kHz) to text, run in batches.

    A small model is given as `model` and sent along; a large one by `load`, a named function that workers call once. Recordings
    without samples have no transcript.
    """
    import pandas as pd

    if (model is None) == (load is None):
        raise ValueError("either a model or a function that loads one")
    fields = ", ".join(f"`{c}` {recordings.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        for batch in batches:
            said = model or loaded(load)
            texts = [None if s is None else said(s).strip() for s in batch["samples"]]
            yield pd.DataFrame({**{c: batch[c] for c in columns}, "transcript": texts})

    return recordings.select(*columns, "samples").mapInPandas(run, f"{fields}, transcript string")
