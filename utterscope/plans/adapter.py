"""Utterance events, labels and a collection plan derived from the `events` table, in Spark and in DuckDB SQL.

The table has no utterances, so a fixed arithmetic of its columns and a bank of phrases stand in: the operators run on the
full event schema, and the SQL says independently what each phrase should give (intent, seconds and word errors).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.schema import VAD_CONFIG

#: phrase_id, transcript, corrected, correct intent, replayed intent, seconds, substitutions, deletions, insertions, words.
BANK = [
    (0, "сколько времени", "сколько времени", "tell_time", "tell_time", None, 0, 0, 0, 2),
    (1, "Скажи, пожалуйста, время!", "скажи пожалуйста время", "tell_time", "tell_time", None, 0, 0, 0, 3),
    (2, "который теперь час", "который теперь час", "tell_time", "tell_time", None, 0, 0, 0, 3),
    (3, "текущее время", "текущее точное время", "tell_time", "tell_time", None, 0, 1, 0, 3),
    (4, "включи музыку", "включи музыку", "play_music", "play_music", None, 0, 0, 0, 2),
    (5, "Открой Spotify", "открой spotify", "play_music", "play_music", None, 0, 0, 0, 2),
    (6, "запусти спотик погромче", "запусти спотик", "play_music", "play_music", None, 0, 0, 1, 2),
    (7, "включи песню", "включи музыку", "play_music", "unknown", None, 1, 0, 0, 2),
    (8, "поставь таймер на пять минут", "поставь таймер на пять минут", "set_timer", "set_timer", 300, 0, 0, 0, 5),
    (9, "поставь на тридцать секунд", "поставь таймер на тридцать секунд", "set_timer", "set_timer", 30, 0, 1, 0, 5),
    (10, "запусти таймер на 2 часа 15 минут", "запусти таймер на два часа пятнадцать минут", "set_timer", "set_timer", 8100, 2, 0, 0, 7),
    (11, "включи таймер на двадцать пять секунд", "включи таймер на двадцать пять секунд", "set_timer", "set_timer", 25, 0, 0, 0, 6),
    (12, "поставь таймер на минуту", "поставь таймер на минуту", "set_timer", "set_timer", 60, 0, 0, 0, 4),
    (13, "поставь таймер минут", "поставь таймер на десять минут", "set_timer", "unknown", None, 0, 2, 0, 5),
    (14, "включи таймер секунд и музыку", "включи музыку", "play_music", "play_music", None, 0, 0, 3, 2),
    (15, "[музыка]", None, "no_speech", "no_speech", None, None, None, None, None),
    (16, "(шум ветра)", None, "no_speech", "no_speech", None, None, None, None, None),
    (17, "*вздыхает*", None, "no_speech", "no_speech", None, None, None, None, None),
    (18, " Тишина. ", None, "no_speech", "no_speech", None, None, None, None, None),
    (19, "как дела", "как дела", "unknown", "unknown", None, 0, 0, 0, 2),
    (20, "расскажи анекдот", "расскажи новый анекдот", "unknown", "unknown", None, 0, 1, 0, 3),
    (21, "[да] нет [наверное]", "да нет наверное", "unknown", "no_speech", None, 0, 0, 0, 3),
    (22, "поставь таймер на 25 часов", "поставь таймер на двадцать пять часов", "set_timer", "unknown", None, 1, 1, 0, 6),
    (23, "", "алло", "unknown", "unknown", None, 0, 1, 0, 1),
]

CAMPAIGN = "bank"


def bank(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:4] for r in BANK], "phrase_id bigint, transcript string, corrected string, correct_intent string")


def plan(spark: SparkSession) -> DataFrame:
    """One prompt for each phrase whose intent a plan may have."""
    rows = bank(spark).where("correct_intent <> 'no_speech'")
    return rows.select(F.lit(CAMPAIGN).alias("campaign"), F.col("phrase_id").cast("int").alias("place"), F.concat(F.lit("p-"), "phrase_id").alias("prompt_id"), F.col("corrected").alias("transcript"), F.col("correct_intent").alias("intent"))


def _base(spark: SparkSession, sf_dir: str, offset: bool = False) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "props", "ts")
    windows = F.expr("cast(floor(value) as bigint) % 40" + (" + if(event_id % 7 <> 0, 6, 0)" if offset else ""))
    stored = F.expr("case when windows < 7 then null when event_type = 'view' then 'tell_time' when event_type = 'purchase' then 'play_music' when event_type = 'signup' then 'set_timer' when event_type = 'click' then 'unknown' else 'no_speech' end")
    return (
        raw.withColumn("windows", windows)
        .withColumn("phrase_id", F.get_json_object("props", "$.k").cast("bigint") % 24)
        .withColumn("id", F.expr("concat('evt-', lpad(cast(event_id as string), 8, '0'))"))
        .withColumn("stored", stored)
        .join(F.broadcast(bank(spark)), "phrase_id")
    )


def events(spark: SparkSession, sf_dir: str, offset: bool = False) -> DataFrame:
    """Events in the full schema, with line_no; `offset` adds six windows to most, so that the sweep has candidates."""
    b = _base(spark, sf_dir, offset)
    floor = F.expr("cast(round(-40 - user_id % 20 - value / 100, 1) as float)")
    peak = F.expr("cast(round(-10 - user_id % 15 - value / 200, 1) as float)")
    status = F.expr("case when windows < 7 or stored = 'no_speech' then 'rejected' when stored = 'unknown' then 'unsupported' when event_id % 97 = 0 then 'failed' else 'succeeded' end")
    return b.select(
        F.expr("cast(1 + event_id % 3 as smallint)").alias("schema_version"), "id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.expr(f"if(event_id % 3 = 0, null, named_struct('app_version', '1', 'session_id', 's', 'whisper_model', 'm', 'parser_version', 1L, 'vad_config', cast(named_struct('level_window_ms', if(event_id % 2 = 0, 10L, 30L), 'calibration_ms', 1000L, 'speech_start_ms', 60L, 'speech_end_ms', 600L, 'min_speech_duration_ms', 140L, 'pre_roll_ms', 300L, 'start_margin_db', 12f, 'end_margin_db', 6f, 'minimum_start_level_dbfs', -35f, 'minimum_end_level_dbfs', -40f) as {VAD_CONFIG})))").alias("provenance"),
        F.expr(f"if(event_id % 6 = 2, named_struct('source', 'prompted', 'campaign', '{CAMPAIGN}', 'prompt_id', concat('p-', phrase_id), 'expected_transcript', corrected, 'expected_intent', correct_intent), null)").alias("collection"),
        F.expr("if(windows < 7, null, concat('audio/', id, '.wav'))").alias("audio_path"),
        F.expr("named_struct('device', concat(if(user_id % 2 = 0, ' ', ''), 'mic-', user_id % 4), 'sample_rate_hz', 48000L, 'channels', 1)").alias("input"),
        F.expr("if(windows < 7, null, transcript)").alias("transcript"),
        F.expr("if(stored is null, null, named_struct('intent', stored, 'slots', cast(map() as map<string,string>)))").alias("prediction"),
        F.struct(status.alias("status"), F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("error")).alias("execution_result"),
        F.when(status == "failed", "the action failed").alias("processing_error"),
        F.when(
            F.expr("event_id % 41 <> 0"),
            F.struct(
                floor.alias("noise_floor_dbfs"), F.greatest(floor + F.lit(12).cast("float"), F.lit(-35).cast("float")).alias("start_threshold_dbfs"), F.greatest(floor + F.lit(6).cast("float"), F.lit(-40).cast("float")).alias("end_threshold_dbfs"),
                peak.alias("peak_dbfs"), (peak - F.lit(6).cast("float")).alias("mean_speech_dbfs"), F.when(F.expr("event_id % 37 <> 0"), peak - F.lit(5).cast("float")).alias("median_speech_dbfs"),
                F.expr("windows * 20 + 300").alias("duration_ms"), F.lit(600).cast("bigint").alias("trailing_silence_ms"), F.expr("if(event_id % 43 = 0, null, windows)").alias("speech_windows"), F.lit(30).cast("bigint").alias("silence_windows"),
                F.expr("case when event_id % 31 = 0 then null when event_id % 29 = 0 then 'maximum_duration' else 'silence' end").alias("end_reason"),
            ),
        ).alias("vad"),
        F.col("event_id").alias("line_no"), F.col("ts").alias("moment"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label log, with label_seq: a first label of most events, and a later correction of some."""
    b = _base(spark, sf_dir)
    first = b.where("event_id % 4 <> 3").select(
        F.lit(1).alias("label_seq"), "id", F.expr("event_id % 7 <> 0").alias("actual_speech"),
        F.expr("if(event_id % 7 = 0 or event_id % 11 = 0, null, corrected)").alias("corrected_transcript"),
        F.expr("case event_id % 5 when 0 then 'tell_time' when 1 then 'play_music' when 2 then 'set_timer' when 3 then 'unknown' else 'no_speech' end").alias("correct_intent"),
    )
    second = b.where("event_id % 10 = 0").select(F.lit(2).alias("label_seq"), "id", F.lit(True).alias("actual_speech"), F.col("corrected").alias("corrected_transcript"), F.coalesce("stored", F.lit("unknown")).alias("correct_intent"))
    both = first.unionByName(second)
    return both.select(F.lit(1).cast("smallint").alias("schema_version"), F.col("id").alias("event_id"), F.lit("2024-01-01T00:00:00Z").alias("labeled_at"), "actual_speech", "corrected_transcript", "correct_intent", F.lit(None).cast("string").alias("notes"), "label_seq")


def _value(x: object) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def ctes(offset: bool = False) -> str:
    """The same in DuckDB SQL: bank, ev (events), lab (latest labels) and sam (events with a label)."""
    rows = ",\n  ".join("(" + ", ".join(map(_value, r)) + ")" for r in BANK)
    more = " + CASE WHEN event_id % 7 <> 0 THEN 6 ELSE 0 END" if offset else ""
    return f"""
bank(phrase_id, phrase, corrected, bank_intent, replay, seconds, subs, dels, ins, n_words) AS (VALUES
  {rows}),
raw AS (
  SELECT *, CAST(floor(value) AS BIGINT) % 40{more} AS windows, CAST(json_extract(props, '$.k') AS BIGINT) % 24 AS phrase_id,
         'evt-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS id FROM events),
ev0 AS (
  SELECT raw.*, bank.* EXCLUDE (phrase_id),
    CASE WHEN windows < 7 THEN NULL WHEN event_type = 'view' THEN 'tell_time' WHEN event_type = 'purchase' THEN 'play_music'
         WHEN event_type = 'signup' THEN 'set_timer' WHEN event_type = 'click' THEN 'unknown' ELSE 'no_speech' END AS stored,
    CASE WHEN windows < 7 THEN NULL ELSE phrase END AS transcript,
    CASE WHEN windows < 7 THEN NULL ELSE replay END AS current_intent,
    CAST(round(-40 - user_id % 20 - value / 100, 1) AS FLOAT) AS floor_db, CAST(round(-10 - user_id % 15 - value / 200, 1) AS FLOAT) AS peak_db,
    event_id % 41 <> 0 AS has_vad, event_id % 6 = 2 AS prompted,
    CASE WHEN event_id % 3 = 0 THEN 20 WHEN event_id % 2 = 0 THEN 10 ELSE 30 END AS window_ms
  FROM raw JOIN bank USING (phrase_id)),
ev AS (
  SELECT *, CASE WHEN windows < 7 OR stored = 'no_speech' THEN 'rejected' WHEN stored = 'unknown' THEN 'unsupported'
                 WHEN event_id % 97 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
    CASE WHEN has_vad AND event_id % 43 <> 0 THEN windows END AS speech_windows,
    CASE WHEN has_vad AND event_id % 31 <> 0 THEN CASE WHEN event_id % 29 = 0 THEN 'maximum_duration' ELSE 'silence' END END AS end_reason
  FROM ev0),
log AS (
  SELECT 1 AS seq, id, event_id % 7 <> 0 AS speech, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE corrected END AS label_text,
    CASE event_id % 5 WHEN 0 THEN 'tell_time' WHEN 1 THEN 'play_music' WHEN 2 THEN 'set_timer' WHEN 3 THEN 'unknown' ELSE 'no_speech' END AS label_intent
  FROM ev WHERE event_id % 4 <> 3
  UNION ALL SELECT 2, id, TRUE, corrected, coalesce(stored, 'unknown') FROM ev WHERE event_id % 10 = 0),
lab AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
sam AS (SELECT ev.*, speech, label_text, label_intent, coalesce(stored, 'unknown') AS historical, coalesce(current_intent, 'unknown') AS present,
    speech AND label_intent NOT IN ('unknown', 'no_speech') AS supported FROM ev JOIN lab USING (id))"""
