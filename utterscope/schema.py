"""Schemas of the event log, the label log and the collection plan.

Field names are the interchange format of the JSONL logs. The producer's version field of `provenance` is named by the
producer; `event_schema` takes that name.
"""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_VERSION = 3
LABEL_VERSION = 1
PLAN_VERSION = 1
LEVEL_WINDOW_MS = 20

INTENTS = ("tell_time", "play_music", "set_timer", "no_speech", "unknown")
PROMPT_INTENTS = ("tell_time", "play_music", "set_timer", "unknown")
STATUSES = ("not_attempted", "rejected", "succeeded", "unsupported", "failed")
END_REASONS = ("silence", "maximum_duration")
COLLECTION_SOURCES = ("prompted",)

VAD_CONFIG = """STRUCT<level_window_ms: BIGINT, calibration_ms: BIGINT, speech_start_ms: BIGINT, speech_end_ms: BIGINT,
  min_speech_duration_ms: BIGINT, pre_roll_ms: BIGINT, start_margin_db: FLOAT, end_margin_db: FLOAT,
  minimum_start_level_dbfs: FLOAT, minimum_end_level_dbfs: FLOAT>"""

VAD = """STRUCT<noise_floor_dbfs: FLOAT, start_threshold_dbfs: FLOAT, end_threshold_dbfs: FLOAT, peak_dbfs: FLOAT,
  mean_speech_dbfs: FLOAT, median_speech_dbfs: FLOAT, duration_ms: BIGINT, trailing_silence_ms: BIGINT,
  speech_windows: BIGINT, silence_windows: BIGINT, end_reason: STRING>"""

VAD_METRICS = (
    "duration_ms", "speech_windows", "peak_dbfs", "mean_speech_dbfs", "median_speech_dbfs", "noise_floor_dbfs",
    "start_threshold_dbfs", "end_threshold_dbfs",
)


def event_ddl(producer_version: str = "app_version") -> str:
    return f"""
  schema_version SMALLINT, id STRING, timestamp STRING,
  provenance STRUCT<{producer_version}: STRING, session_id: STRING, whisper_model: STRING, parser_version: BIGINT, vad_config: {VAD_CONFIG}>,
  collection STRUCT<source: STRING, campaign: STRING, prompt_id: STRING, expected_transcript: STRING, expected_intent: STRING>,
  audio_path STRING,
  input STRUCT<device: STRING, sample_rate_hz: BIGINT, channels: INT>,
  transcript STRING,
  prediction STRUCT<intent: STRING, slots: MAP<STRING, STRING>>,
  execution_result STRUCT<status: STRING, response: STRING, error: STRING>,
  processing_error STRING,
  vad {VAD},
  ground_truth STRUCT<corrected_transcript: STRING, correct_intent: STRING, actual_speech: BOOLEAN, notes: STRING>"""


def event_schema(producer_version: str = "app_version") -> T.StructType:
    return T.StructType.fromDDL(event_ddl(producer_version))


LABEL_DDL = "schema_version SMALLINT, event_id STRING, labeled_at STRING, actual_speech BOOLEAN, corrected_transcript STRING, correct_intent STRING, notes STRING"
PLAN_DDL = "schema_version INT, campaign STRING, prompts ARRAY<STRUCT<id: STRING, transcript: STRING, intent: STRING>>"


def label_schema() -> T.StructType:
    return T.StructType.fromDDL(LABEL_DDL)


#: Paths that every line must have; a line without one is an error, as is a null there.
EVENT_REQUIRED = (
    "schema_version", "id", "timestamp", "input.device", "input.sample_rate_hz", "input.channels", "execution_result.status",
)
LABEL_REQUIRED = ("schema_version", "event_id", "labeled_at", "actual_speech", "correct_intent")
