"""Named queries through the logs, plans and WAV files, over audio columns and over a stream, each with its SQL.

What is written goes to a folder of its own under the shared one and is read back, so a query passes its writer and reader.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterscope.functions import audio
from utterscope.functions.stats import distribution
from utterscope.functions.text import file_stem, words
from utterscope.functions.wer import word_errors
from utterscope.operators import collect, levels, process, review, vad
from utterscope.operators.vad_chunks import detect_long
from utterscope.plans import adapter, oracles
from utterscope.plans.queries import SMALL, _frames, _vad_segments
from utterscope.sources import jsonl, wav
from utterscope.sources.scratch import new_path
from utterscope.streaming.vad_stream import append_stream, detect_stream

#: Samples of a recording: so many events, by id.
CHUNK = 100
RATE = 500

_EVENT_FIELDS = (
    "schema_version", "id", "timestamp", "provenance.vad_config.level_window_ms", "collection.prompt_id", "collection.expected_intent", "audio_path",
    "input.device", "input.sample_rate_hz", "transcript", "prediction.intent", "execution_result.status", "processing_error", "vad.speech_windows", "vad.end_reason",
)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in three writes to one log of JSON lines and read back strictly, with the append that each is of."""
    path = new_path(spark, "events")
    events = adapter.events(spark, sf_dir)
    for part in (2, 0, 1):
        jsonl.append_events(events.where(F.col("line_no") % 3 == part), path)
    append = F.regexp_extract("file", r"/(\d{10})/[^/]*$", 1).cast("int")
    return jsonl.read_events(spark, path).select(*_EVENT_FIELDS, append.alias("append"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad lines of a log whose every 11th line lacks a field, by whether their numbers are those of the lines."""
    path = new_path(spark, "lines")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    device = F.when(F.col("event_id") % 11 == 0, '"host"').otherwise('"device"')
    line = F.concat(
        F.lit('{"schema_version": 1, "id": "'), F.col("event_id").cast("string"), F.lit('", "timestamp": "t", "input": {'), device,
        F.lit(': "mic", "sample_rate_hz": 16000, "channels": 1}, "execution_result": {"status": "rejected"}}'),
    )
    blank = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("\n"), line)).otherwise(line)  # a blank line before every seventh
    events.repartition(3).select(blank).write.text(path)
    good, bad = jsonl.split_events(spark, path)
    again = jsonl.numbered_lines(spark, path).select("file", "line_no", F.get_json_object("value", "$.id").alias("again"))
    read = good.select("id", "file", "line_no").unionByName(bad.select(F.get_json_object("value", "$.id").alias("id"), "file", "line_no").withColumn("bad", F.lit(True)), True)
    placed = read.join(again, ["file", "line_no"]).select(F.col("id").cast("bigint").alias("event_id"), F.coalesce("bad", F.lit(False)).alias("bad"), (F.col("id") == F.col("again")).alias("placed"))
    return placed


def label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First labels, corrections and some first labels again, appended to one log; the last label of each event."""
    path = new_path(spark, "labels")
    labels = adapter.labels(spark, sf_dir)
    for part in ("label_seq = 1", "label_seq = 2", "label_seq = 1 and substr(event_id, -1) = '0' and substr(event_id, -2, 1) < '5'"):
        jsonl.append_labels(labels.where(part), path)
    return jsonl.latest_labels(jsonl.read_labels(spark, path)).select("event_id", "actual_speech", "corrected_transcript", "correct_intent")


def analytics_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a log's Parquet copy."""
    path = new_path(spark, "copy")
    jsonl.to_parquet(adapter.events(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("schema_version").agg(F.count(F.lit(1)).alias("n"), F.count("transcript").alias("transcripts"))


def plan_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection plan of the phrases that were heard, written as JSON, checked and read back in the order of its prompts."""
    path = new_path(spark, "plan")
    prompt = F.struct(F.col("place"), F.col("prompt_id").alias("id"), "transcript", "intent")
    heard = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.get_json_object("props", "$.k").cast("int") % 24).alias("place"))
    one = adapter.plan(spark).join(heard, "place", "left_semi").agg(F.array_sort(F.collect_list(prompt)).alias("prompts"))
    kept = F.transform("prompts", lambda p: F.struct(p["id"].alias("id"), p["transcript"].alias("transcript"), p["intent"].alias("intent")))
    one.select(F.lit(1).alias("schema_version"), F.lit(adapter.CAMPAIGN).alias("campaign"), kept.alias("prompts")).coalesce(1).write.json(path)
    return jsonl.read_plan(spark, path).select("campaign", F.col("place").cast("bigint").alias("place"), "prompt_id", "transcript", "intent")


def plan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of the users' events, of which most break a rule: the first that each breaks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("user_id") % 7
    bad = (kind == 3) & (F.col("event_id") % 5 == 0)
    key = F.when(kind == 5, F.col("event_id") % 50).otherwise(F.col("event_id")).cast("string")
    intent = F.when((kind == 4) & (F.col("event_type") == "error"), "no_speech").otherwise("unknown")
    transcript = F.when(bad & (F.col("event_id") % 2 == 0), " ").when(bad, None).otherwise("a phrase")
    prompt = F.struct("event_id", key.alias("id"), transcript.alias("transcript"), intent.alias("intent"))
    plans = e.groupBy("user_id").agg(F.array_sort(F.collect_list(prompt)).alias("prompts")).select(
        "user_id", F.when(kind == 0, 2).otherwise(1).alias("schema_version"), F.when(kind == 1, " \t").otherwise("a campaign").alias("campaign"),
        F.when(kind != 2, F.col("prompts")).alias("prompts"),
    )
    return jsonl.plan_problems(plans).select("user_id", F.coalesce(F.size("prompts"), F.lit(0)).cast("bigint").alias("n"), "problem")


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events by the hundred as recordings, stereo if their number is even: their values, in the order of their ids."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = F.struct("event_id", audio.i16_from_float(F.col("value") / 500 - 0.5).alias("s"))
    chunks = e.groupBy(F.floor(F.col("event_id") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    channels = F.when(F.size("x") % 2 == 0, 2).otherwise(1).alias("channels")
    return chunks.select(F.concat(F.lit("rec-"), "chunk").alias("id"), F.transform("x", lambda x: x["s"]).alias("samples"), F.lit(RATE).alias("sample_rate_hz"), channels)


def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings written as WAV files and read back."""
    root = new_path(spark, "wav")
    written = wav.write_wavs(_recordings(spark, sf_dir), root).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if not written:
        return spark.createDataFrame([], "id string, n_samples bigint, total bigint, sample_rate_hz int, channels int")
    files = wav.read_wavs(spark, f"{root}/audio")
    total = F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, s: a + s)
    return files.select(F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("id"), F.size("samples").cast("bigint").alias("n_samples"), total.alias("total"), "sample_rate_hz", "channels")


def recording_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and meters of 20 ms windows of stereo recordings."""
    found = levels.levels_of_recordings(_recordings(spark, sf_dir))
    return found.select("id", "window_idx", F.round(F.col("rms").cast("double"), 4).alias("rms"), "end_frame", audio.meter(F.round(F.col("dbfs").cast("double"), 0)).alias("meter"))


def mono_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of stereo recordings as means of their channels, cut to a slice."""
    r = _recordings(spark, sf_dir)
    part = r.withColumn("part", audio.slice_frames(F.col("samples"), F.col("channels"), F.lit(1), F.floor(F.size("samples") / F.col("channels"))))
    mixed = part.select("id", F.posexplode(audio.mono(F.col("part"), F.col("channels"))).alias("frame", "level"))
    return mixed.select("id", F.col("frame").cast("bigint").alias("frame"), F.round(F.col("level").cast("double"), 5).alias("level"))


def pcm_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float and unsigned samples as signed ones, beyond full scale too."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = F.col("value") / 200 - 1.2
    unsigned = F.floor(F.col("value") * 133).cast("int") % 65536
    return e.select("event_id", audio.i16_from_float(x).cast("int").alias("from_float"), audio.i16_from_u16(unsigned).cast("int").alias("from_u16"))


def stt_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many mono samples at 16 kHz a recording has for the speech model."""
    prepared = audio.prepare_for_stt("samples", "sample_rate_hz", "channels")
    return _recordings(spark, sf_dir).select("id", F.size(prepared).cast("bigint").alias("n_samples"))


#: Rates to which recordings of RATE are resampled, up and down.
RATES = (800, 300)


def resampled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of recordings at a higher and a lower rate."""
    mixed = _recordings(spark, sf_dir).select("id", audio.mono(F.col("samples"), F.col("channels")).cast("array<double>").alias("x"), F.explode(F.array(*map(F.lit, RATES))).alias("rate"))
    made = mixed.select("id", "rate", F.posexplode(audio.resample_to("x", F.lit(RATE), "rate")).alias("n", "y"))
    return made.select("id", "rate", F.col("n").cast("bigint").alias("n"), F.round("y", 4).alias("y"))


def load_counter() -> Callable:
    """A stand-in for a speech model: it says how many samples are loud, and how many there are."""
    return lambda samples: f" {int((samples > 0.1).sum())} of {len(samples)}\n"


def model_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model that workers load makes of the recordings."""
    mono = _recordings(spark, sf_dir).select("id", audio.mono(F.col("samples"), F.col("channels")).alias("samples"))
    return process.transcribe(mono, load=load_counter)


def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of durations, windows of milliseconds, starts with their pre-roll and file stems."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rate = (F.col("user_id") * 331 % 48000 + 1).cast("bigint")
    return e.select(
        "event_id", audio.frames_for(rate, 0.02).alias("window_frames"), audio.windows_for(F.floor("value")).cast("bigint").alias("windows"),
        audio.pre_roll_start(F.col("event_id"), rate).alias("start"), file_stem(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("stem"),
        process.has_minimum_speech((F.col("event_id") % 12).cast("bigint")).alias("long_enough"),
    )


def segment_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log's telemetry of detected segments."""
    told = process.telemetry(_vad_segments(spark, sf_dir), F.lit(10), F.col("start_frame"), F.col("end_frame"))
    return told.select("session", "utterance", "vad.duration_ms", "vad.trailing_silence_ms", "vad.speech_windows", "vad.silence_windows", "vad.end_reason")


def prompted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event of a collection with its prompt's metadata."""
    events = adapter.events(spark, sf_dir).drop("collection").withColumn("prompt_id", F.expr("if(line_no % 5 = 0, concat('p-', line_no % 30), null)"))
    return collect.with_prompt(events, adapter.plan(spark)).select("id", "collection.source", "collection.campaign", "collection.prompt_id", "collection.expected_transcript", "collection.expected_intent")


def decided_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a reviewer's decisions about the queue: defaults kept, changed, or turned to non-speech."""
    queue = review.review_queue(adapter.events(spark, sf_dir), adapter.labels(spark, sf_dir))
    kind = F.col("line_no") % 5
    decisions = queue.select(
        F.col("id").alias("event_id"), F.when(kind == 3, "skip").otherwise("save").alias("action"), F.when(kind == 1, False).when(kind == 2, True).alias("actual_speech"),
        F.when(kind == 2, "слово").alias("corrected_transcript"), F.when(kind == 2, "play_music").alias("correct_intent"), F.when(kind == 0, "").when(kind == 2, "note").alias("notes"),
    )
    return review.apply_decisions(queue, decisions).drop("labeled_at")


def phrase_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of each event's phrase against another phrase of the bank."""
    bank = adapter.bank(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.get_json_object("props", "$.k").cast("bigint") % 24).alias("a"), (F.col("event_id") % 24).alias("b"))
    pairs = e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    texts = F.broadcast(bank.select(F.col("phrase_id"), words(F.col("transcript")).alias("w")))  # 24 rows
    both = pairs.join(texts.toDF("a", "wa"), "a").join(texts.toDF("b", "wb"), "b")
    return both.select("a", "b", "n", word_errors(F.col("wa"), F.col("wb")).alias("e")).select("a", "b", "n", *[F.col(f"e.{c}").alias(name) for c, name in zip("csdi", ("edits", "substitutions", "deletions", "insertions"))])


def vad_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's events of a stream of levels, appended to a table."""
    source, sink = new_path(spark, "levels"), new_path(spark, "stream")
    found = levels.levels_of_frames(_frames(spark, sf_dir), ["session"], "frame", "x", 2)
    found.select("session", "window_idx", "dbfs", "end_frame").write.parquet(source)
    stream = spark.readStream.schema("session string, window_idx bigint, dbfs float, end_frame bigint").parquet(source)
    query = append_stream(detect_stream(stream, SMALL), f"{sink}/table", f"{sink}/checkpoint")
    query.awaitTermination()
    schema = T.StructType([T.StructField("session", T.StringType()), *T.StructType.fromDDL(vad.EVENTS).fields])
    return spark.read.schema(schema).parquet(f"{sink}/table")


def vad_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's events with every session cut into chunks of 20 windows that begin at once."""
    found = levels.levels_of_frames(_frames(spark, sf_dir), ["session"], "frame", "x", 2)
    return detect_long(found, "session", SMALL, 20)


def nan_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact order statistics of values of which some are no numbers, infinite or a negative zero."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_id") % 40
    value = F.when(kind < 3, float("nan")).when(kind == 3, float("-inf")).when(kind == 4, -0.0).otherwise(F.col("value") - 100)
    found = distribution(e.select("event_type", value.alias("value")), ["event_type"], "value")
    return found.select("event_type", "count", "minimum", "median", "percentile_95", F.isnan("maximum").alias("ends_in_nan"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "event_log": event_log, "event_lines": event_lines, "label_log": label_log, "analytics_copy": analytics_copy, "plan_scan": plan_scan, "plan_rules": plan_rules, "wav_files": wav_files,
    "recording_levels": recording_levels, "mono_recordings": mono_recordings, "pcm_samples": pcm_samples, "stt_lengths": stt_lengths, "frame_counts": frame_counts,
    "resampled_values": resampled_values, "model_transcripts": model_transcripts, "segment_telemetry": segment_telemetry, "prompted_events": prompted_events, "decided_labels": decided_labels, "phrase_errors": phrase_errors, "vad_stream": vad_stream, "vad_chunks": vad_chunks, "nan_distribution": nan_distribution,
}

_I16 = "CAST(round(greatest(least({0}, 1.0), -1.0) * 32767) AS INTEGER)"
_SAMPLES = f"""samples AS (
  SELECT 'rec-' || (event_id // {CHUNK}) AS id, {_I16.format("(value / 500 - 0.5)")} AS s, row_number() OVER (PARTITION BY event_id // {CHUNK} ORDER BY event_id) - 1 AS k,
         count(*) OVER (PARTITION BY event_id // {CHUNK}) AS n FROM events),
whole AS (SELECT *, CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END AS channels FROM samples)"""

ORACLES: dict[str, str] = {
    "event_log": oracles._with("""SELECT CAST(1 + event_id % 3 AS SMALLINT) AS schema_version, id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(window_ms AS BIGINT) END AS level_window_ms,
  CASE WHEN prompted THEN 'p-' || phrase_id END AS prompt_id, CASE WHEN prompted THEN bank_intent END AS expected_intent, CASE WHEN windows >= 7 THEN 'audio/' || id || '.wav' END AS audio_path,
  CASE WHEN user_id % 2 = 0 THEN ' ' ELSE '' END || 'mic-' || (user_id % 4) AS device, CAST(48000 AS BIGINT) AS sample_rate_hz, transcript, stored AS intent, status,
  CASE WHEN status = 'failed' THEN 'the action failed' END AS processing_error, speech_windows, end_reason,
  CAST((event_id + 1) % 3 + 1 AS INTEGER) AS append FROM ev"""),
    "event_lines": "SELECT event_id, event_id % 11 = 0 AS bad, TRUE AS placed FROM events",
    "label_log": oracles._with("""SELECT id AS event_id, speech AS actual_speech, label_text AS corrected_transcript, label_intent AS correct_intent
FROM (SELECT *, CASE WHEN seq = 1 AND right(id, 1) = '0' AND substr(right(id, 2), 1, 1) < '5' THEN 3 ELSE seq END AS append FROM log)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY append DESC) = 1"""),
    "analytics_copy": oracles._with("SELECT CAST(1 + event_id % 3 AS SMALLINT) AS schema_version, count(*) AS n, count(transcript) AS transcripts FROM ev GROUP BY 1"),
    "plan_scan": oracles._with(f"SELECT '{adapter.CAMPAIGN}' AS campaign, row_number() OVER (ORDER BY phrase_id) - 1 AS place, 'p-' || phrase_id AS prompt_id, corrected AS transcript, bank_intent AS intent FROM bank WHERE bank_intent <> 'no_speech' AND phrase_id IN (SELECT phrase_id FROM raw)"),
    "plan_rules": """SELECT user_id, n, CASE
  WHEN user_id % 7 = 0 THEN 'unsupported collection plan schema 2; expected 1' WHEN user_id % 7 = 1 THEN 'collection campaign must not be empty'
  WHEN n = 0 THEN 'collection plan must contain at least one prompt' ELSE problem END AS problem
FROM (
  SELECT user_id, CASE WHEN user_id % 7 = 2 THEN 0 ELSE count(*) END AS n, min(CASE
      WHEN user_id % 7 = 3 AND event_id % 5 = 0 THEN {'k': k, 'w': 'collection prompt ID and transcript must not be empty'}
      WHEN event_type = 'error' AND user_id % 7 = 4 THEN {'k': k, 'w': 'unsupported expected intent ''no_speech'''}
      WHEN again AND user_id % 7 = 5 THEN {'k': k, 'w': 'duplicate collection prompt ID ''' || id || ''''} END).w AS problem
  FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, row_number() OVER (PARTITION BY user_id, id ORDER BY event_id) > 1 AS again
    FROM (SELECT *, CASE WHEN user_id % 7 = 5 THEN CAST(event_id % 50 AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS id FROM events))
  GROUP BY user_id)""",
    "wav_files": f"WITH {_SAMPLES} SELECT id, count(*) AS n_samples, CAST(sum(s) AS BIGINT) AS total, {RATE} AS sample_rate_hz, max(channels) AS channels FROM whole GROUP BY id",
    "recording_levels": f"""WITH {_SAMPLES},
mixed AS (SELECT id, k // channels AS f, sum(s / 32768.0::DOUBLE) / max(channels) AS x FROM whole GROUP BY 1, 2),
win AS (SELECT id, CAST(f // 10 AS BIGINT) AS window_idx, CAST(sqrt(sum(x * x) / 10) AS FLOAT) AS rms FROM mixed GROUP BY 1, 2 HAVING count(*) = 10),
cells AS (SELECT *, CAST(round(20 * greatest(0.0, least(1.0, (round(CAST(CAST(20 * log10(greatest(CAST(rms AS DOUBLE), 1e-12)) AS FLOAT) AS DOUBLE)) + 60) / 60))) AS INTEGER) AS c FROM win)
SELECT id, window_idx, round(CAST(rms AS DOUBLE), 4) AS rms, (window_idx + 1) * 10 AS end_frame, repeat('#', c) || repeat('-', 20 - c) AS meter FROM cells""",
    "mono_recordings": f"WITH {_SAMPLES} SELECT id, k // channels - 1 AS frame, round(CAST(CAST(sum(s / 32768.0::DOUBLE) / max(channels) AS FLOAT) AS DOUBLE), 5) AS level FROM whole WHERE k >= channels GROUP BY id, k // channels",
    "pcm_samples": f"SELECT event_id, {_I16.format('(value / 200 - 1.2)')} AS from_float, CAST(floor(value * 133) AS INTEGER) % 65536 - 32768 AS from_u16 FROM events",
    "stt_lengths": f"WITH {_SAMPLES} SELECT id, CAST(floor(count(*) // max(channels) * 16000 / {RATE}.0 + 0.5) AS BIGINT) AS n_samples FROM whole GROUP BY id",
    "resampled_values": f"""WITH {_SAMPLES},
mixed AS (SELECT id, k // channels AS k, sum(s / 32768.0::DOUBLE) / max(channels) AS x FROM whole GROUP BY id, k // channels),
size AS (SELECT id, count(*) AS len FROM mixed GROUP BY id),
rates AS (SELECT rate, CAST(ceil({audio.SIDE} / least(1.0, rate / {RATE}.0)) AS BIGINT) AS half, least(1.0::DOUBLE, rate / {RATE}.0::DOUBLE) * {(1 + audio.PASS) / 2} AS band FROM (VALUES ({RATES[0]}), ({RATES[1]})) t(rate)),
places AS (
  SELECT id, rate, half, band, n, n * {RATE}.0::DOUBLE / rate AS place
  FROM (SELECT *, unnest(range(CAST(floor(len * rate / {RATE}.0 + 0.5) AS BIGINT))) AS n FROM size CROSS JOIN rates)),
phases AS (SELECT DISTINCT rate, half, band, n * {RATE} % rate AS phase FROM places),
shapes AS (SELECT rate, half, phase, band, phase / rate::DOUBLE + unnest(range(-half, half + 1)) AS d FROM phases),
weights AS (
  SELECT rate, phase, d, (0.42 + 0.5 * cos(pi() * d / half) + 0.08 * cos(2 * pi() * d / half))
    * CASE WHEN abs(d) >= half THEN 0 WHEN d = 0 THEN 1 ELSE sin(pi() * d * band) / (pi() * d * band) END AS w FROM shapes),
whole_weights AS (SELECT rate, phase, sum(w) AS w FROM weights GROUP BY ALL),
shaped AS (
  SELECT p.id, p.rate, n, n * {RATE} % p.rate AS phase, x, place - k AS d, half, band
  FROM places p JOIN mixed m ON m.id = p.id AND abs(place - k) < half)
SELECT id, rate, n, round(sum(x * (0.42 + 0.5 * cos(pi() * d / half) + 0.08 * cos(2 * pi() * d / half))
  * CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d * band) / (pi() * d * band) END) / max(w), 4) AS y
FROM shaped JOIN whole_weights USING (rate, phase) GROUP BY id, rate, n""",
    "model_transcripts": f"""WITH {_SAMPLES},
mixed AS (SELECT id, k // channels AS k, CAST(sum(s / 32768.0::DOUBLE) / max(channels) AS FLOAT) AS x FROM whole GROUP BY id, k // channels)
SELECT id, count_if(x > 0.1) || ' of ' || count(*) AS transcript FROM mixed GROUP BY id""",
    "frame_counts": """SELECT event_id, CAST(round(rate * 0.02::DOUBLE) AS BIGINT) AS window_frames, CAST(ceil(floor(value) / 20) AS BIGINT) AS windows,
  greatest(0, event_id - CAST(round(rate * 0.3::DOUBLE) AS BIGINT)) AS start, strftime(ts, '%Y-%m-%dT%H-%M-%S-%gZ') AS stem, event_id % 12 >= 7 AS long_enough
FROM (SELECT *, CAST(user_id * 331 % 48000 + 1 AS DOUBLE) AS rate FROM events)""",
    "segment_telemetry": f"""{oracles._VAD_RUN} SELECT e.session, e.utterance, CAST((e.at_frame - greatest(0, s.at_frame - 3)) * 100 AS BIGINT) AS duration_ms,
  e.trailing_silence_windows * 20 AS trailing_silence_ms, e.speech_windows, e.silence_windows, e.end_reason
FROM told e JOIN told s USING (session, utterance) WHERE e.event = 'speech_ended' AND s.event = 'speech_started'""",
    "prompted_events": oracles._with(f"""SELECT ev.id, CASE WHEN b.phrase_id IS NOT NULL THEN 'prompted' END AS source, CASE WHEN b.phrase_id IS NOT NULL THEN '{adapter.CAMPAIGN}' END AS campaign,
  'p-' || b.phrase_id AS prompt_id, b.corrected AS expected_transcript, b.bank_intent AS expected_intent
FROM ev LEFT JOIN bank b ON b.phrase_id = ev.event_id % 30 AND ev.event_id % 5 = 0 AND b.bank_intent <> 'no_speech'"""),
    "decided_labels": oracles._with("""SELECT CAST(1 AS SMALLINT) AS schema_version, id AS event_id, speech AS actual_speech,
  CASE WHEN speech THEN CASE WHEN kind = 2 THEN 'слово' ELSE coalesce(transcript, '') END END AS corrected_transcript,
  CASE WHEN NOT speech THEN 'no_speech' WHEN kind = 2 THEN 'play_music' ELSE coalesce(stored, 'unknown') END AS correct_intent, CASE WHEN kind = 2 THEN 'note' END AS notes
FROM (SELECT *, event_id % 5 AS kind, CASE event_id % 5 WHEN 1 THEN FALSE WHEN 2 THEN TRUE ELSE coalesce(transcript IS NOT NULL AND stored <> 'no_speech', FALSE) END AS speech
  FROM ev WHERE id NOT IN (SELECT id FROM log)) WHERE kind <> 3"""),
    "phrase_errors": f"""WITH RECURSIVE {adapter.ctes()},
tokens AS MATERIALIZED (SELECT phrase_id, string_split_regex(trim(regexp_replace(lower(phrase), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w0 FROM bank),
said AS MATERIALIZED (SELECT phrase_id, list_filter(w0, lambda x: x <> '') AS w FROM tokens),
pairs AS MATERIALIZED (SELECT phrase_id AS a, event_id % 24 AS b, count(*) AS n FROM raw GROUP BY 1, 2),
table_(a, b, x, cells) AS (
  SELECT a, b, 0, list_transform(range(len(h.w) + 1), lambda y: {{'c': y, 's': 0::BIGINT, 'd': 0::BIGINT, 'i': y}}) FROM pairs JOIN said h ON h.phrase_id = b
  UNION ALL
  SELECT t.a, t.b, x + 1, list_reduce(range(1, len(h.w) + 1), lambda new, y: list_append(new,
      CASE WHEN r.w[x + 1] = h.w[y] THEN cells[y]
        WHEN cells[y].c <= cells[y + 1].c AND cells[y].c <= new[y].c THEN {{'c': cells[y].c + 1, 's': cells[y].s + 1, 'd': cells[y].d, 'i': cells[y].i}}
        WHEN cells[y + 1].c <= new[y].c THEN {{'c': cells[y + 1].c + 1, 's': cells[y + 1].s, 'd': cells[y + 1].d + 1, 'i': cells[y + 1].i}}
        ELSE {{'c': new[y].c + 1, 's': new[y].s, 'd': new[y].d, 'i': new[y].i + 1}} END),
    [{{'c': cells[1].c + 1, 's': cells[1].s, 'd': cells[1].d + 1, 'i': cells[1].i}}])
  FROM table_ t JOIN said r ON r.phrase_id = t.a JOIN said h ON h.phrase_id = t.b WHERE x < len(r.w)),
ends AS (SELECT t.a, t.b, cells[len(cells)] AS e FROM table_ t JOIN said r ON r.phrase_id = t.a WHERE x = len(r.w))
SELECT a, b, n, CAST(e.c AS INTEGER) AS edits, CAST(e.s AS INTEGER) AS substitutions, CAST(e.d AS INTEGER) AS deletions, CAST(e.i AS INTEGER) AS insertions FROM pairs JOIN ends USING (a, b)""",
    "vad_stream": oracles.ORACLES["vad_events"],
    "vad_chunks": oracles.ORACLES["vad_events"],
    "nan_distribution": """SELECT event_type, count(*) AS count, min(v) AS minimum, (max(v) FILTER (k = (n - 1) // 2) + max(v) FILTER (k = n // 2)) / 2 AS median,
  max(v) FILTER (k = ceil(n * 0.95) - 1) AS percentile_95, isnan(max(v)) AS ends_in_nan
FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY v) - 1 AS k
  FROM (SELECT event_type, CASE WHEN event_id % 40 < 3 THEN 'nan'::DOUBLE WHEN event_id % 40 = 3 THEN '-inf'::DOUBLE WHEN event_id % 40 = 4 THEN 0.0 ELSE value - 100 END AS v FROM events))
GROUP BY event_type""",
}
