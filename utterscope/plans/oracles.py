"""DuckDB SQL for the queries; the rows and columns are the same."""

from __future__ import annotations

from utterscope.plans.adapter import ctes
from utterscope.operators.sweep import GRID, RECALLS


def _with(body: str, offset: bool = False) -> str:
    return f"WITH {ctes(offset)}\n{body}"


def _counts(column: str, name: str, source: str = "ev") -> str:
    return _with(f"SELECT {column} AS {name}, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1")


_CHANGE = "CASE WHEN stored <> current_intent THEN stored || ' -> ' || current_intent END"
_DEVICE = "'mic-' || (user_id % 4)"

_BLOCKS = {
    "execution_statuses": "status", "stored_intents": "stored", "current_intents": "current_intent",
    "prediction_changes": _CHANGE, "devices": _DEVICE, "end_reasons": "end_reason",
}

_VAD = {
    "duration_ms": "CASE WHEN has_vad THEN windows * 20 + 300 END",
    "speech_windows": "speech_windows",
    "peak_dbfs": "CASE WHEN has_vad THEN peak_db END",
    "mean_speech_dbfs": "CASE WHEN has_vad THEN peak_db - 6::FLOAT END",
    "median_speech_dbfs": "CASE WHEN has_vad AND event_id % 37 <> 0 THEN peak_db - 5::FLOAT END",
    "noise_floor_dbfs": "CASE WHEN has_vad THEN floor_db END",
    "start_threshold_dbfs": "CASE WHEN has_vad THEN greatest(floor_db + 12::FLOAT, -35::FLOAT) END",
    "end_threshold_dbfs": "CASE WHEN has_vad THEN greatest(floor_db + 6::FLOAT, -40::FLOAT) END",
}


def _values(names: tuple[str, ...], source: str, keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{n}' AS metric, CAST({_VAD[n]} AS DOUBLE) AS v FROM {source}" for n in names)


def _spread(keys: str, p95: bool) -> str:
    extra = "quantile_disc(v, 0.95) AS percentile_95, " if p95 else ""
    return f"SELECT {keys}, count(*) AS count, min(v) AS minimum, median(v) AS median, {extra}round(avg(v), 6) AS mean, max(v) AS maximum"


_GRID = f"generate_series({GRID.start}, {GRID.stop - 1}, {GRID.step})"


def _sweep(source: str, speech: str, value: str, grid: str) -> str:
    return f"""
obs AS (SELECT {speech} AS speech, {value} AS v FROM {source} WHERE {value} IS NOT NULL),
grid AS (SELECT unnest({grid}) AS threshold_ms),
swept AS (
  SELECT CAST(threshold_ms AS BIGINT) AS threshold_ms, count(*) FILTER (speech AND v >= threshold_ms) AS speech_kept,
    count(*) FILTER (speech AND v < threshold_ms) AS speech_rejected, count(*) FILTER (NOT speech AND v >= threshold_ms) AS non_speech_kept,
    count(*) FILTER (NOT speech AND v < threshold_ms) AS non_speech_rejected
  FROM grid LEFT JOIN obs ON TRUE GROUP BY 1),
sweep AS (
  SELECT *, speech_kept::DOUBLE / nullif(speech_kept + speech_rejected, 0) AS speech_recall,
    non_speech_rejected::DOUBLE / nullif(non_speech_kept + non_speech_rejected, 0) AS noise_rejection_rate FROM swept)"""


def _utterance_sweep(body: str, offset: bool) -> str:
    return _with(body, offset).replace("\n" + body, "," + _sweep("sam", "speech", "speech_windows * window_ms", _GRID) + "\n" + body)


_CANDIDATES = " UNION ".join(f"SELECT max(threshold_ms) AS threshold_ms FROM sweep WHERE noise_rejection_rate IS NOT NULL AND speech_recall >= {r} HAVING max(threshold_ms) IS NOT NULL" for r in RECALLS)

_ERRORS = """SELECT id AS event_id, CAST(CASE WHEN transcript IS NULL THEN 0 ELSE subs END AS INTEGER) AS substitutions,
  CAST(CASE WHEN transcript IS NULL THEN n_words ELSE dels END AS INTEGER) AS deletions,
  CAST(CASE WHEN transcript IS NULL THEN 0 ELSE ins END AS INTEGER) AS insertions, CAST(n_words AS INTEGER) AS reference_words,
  CASE WHEN transcript IS NULL THEN 1.0 ELSE (subs + dels + ins)::DOUBLE / n_words END AS wer
FROM sam WHERE speech AND label_text IS NOT NULL"""


def _mistakes(where: str, wrong: str, expected: str) -> str:
    return _with(" UNION ALL ".join(
        f"SELECT '{name}' AS parser, id AS event_id, {expected}{col} AS predicted, coalesce(transcript, '') AS transcript FROM sam WHERE {where} AND {wrong.format(col)}"
        for name, col in (("historical", "historical"), ("current", "present"))
    ))


def _accuracy(col: str) -> str:
    return _with(f"SELECT count(*) FILTER ({col} = label_intent) AS correct, count(*) AS total, count(*) FILTER ({col} = label_intent)::DOUBLE / nullif(count(*), 0) AS accuracy FROM sam WHERE supported")


def _confusion(col: str) -> str:
    return _with(f"SELECT label_intent AS expected, {col} AS predicted, count(*) AS n FROM sam WHERE supported GROUP BY 1, 2")


_SPOKEN = "CASE seconds WHEN 300 THEN '5 минут' WHEN 30 THEN '30 секунд' WHEN 8100 THEN '2 часа 15 минут' WHEN 25 THEN '25 секунд' WHEN 60 THEN '1 минуту' END"

#: The detector as a recursion over a session's windows, with the small configuration of the query.
_MEDIAN = "CASE WHEN len({0}) % 2 = 1 THEN list_sort({0})[len({0}) // 2 + 1] ELSE CAST((list_sort({0})[len({0}) // 2] + list_sort({0})[len({0}) // 2 + 1]) / 2::FLOAT AS FLOAT) END"

def vad_run(level: str = "x") -> str:
    """The detector in SQL over levels of two frames each; `level` makes them of the frames' values x."""
    return f"""WITH RECURSIVE
frames AS (
  SELECT session, f, {level} AS x FROM (
    SELECT CAST(user_id AS VARCHAR) AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS f, value / 500 AS x FROM events)),
win AS MATERIALIZED (
  SELECT session, CAST(f // 2 AS BIGINT) AS w, CAST(20 * log10(CAST(CAST(sqrt(sum(x * x) / 2) AS FLOAT) AS DOUBLE)) AS FLOAT) AS db FROM frames GROUP BY 1, 2 HAVING count(*) = 2),
run AS (
  SELECT session, CAST(-1 AS BIGINT) AS w, 'calibrating' AS phase, NULL::FLOAT AS floor_db, []::FLOAT[] AS levels, 0 AS waited, 0 AS elapsed, 0 AS quiet, 0 AS silent, NULL::FLOAT AS peak,
    CAST(0 AS BIGINT) AS utterance, NULL::VARCHAR AS event, NULL::VARCHAR AS reason, NULL::FLOAT AS end_db, []::FLOAT[] AS said, 0 AS was_quiet, 0 AS was_silent, NULL::FLOAT AS top, CAST(0 AS BIGINT) AS of_utterance
  FROM (SELECT DISTINCT session FROM win)
  UNION ALL
  SELECT session, w,
    CASE WHEN event = 'speech_started' THEN 'speaking' WHEN event IS NOT NULL THEN 'waiting' ELSE phase END,
    CASE WHEN event = 'calibrated' THEN calibrated ELSE floor_now END,
    CASE WHEN event IS NULL OR event = 'speech_started' THEN levels_now ELSE [] END,
    CASE WHEN event IS NULL AND phase = 'waiting' THEN waited + 1 ELSE 0 END,
    CASE WHEN event IS NULL AND phase = 'speaking' THEN elapsed + 1 ELSE 0 END,
    CASE WHEN event IS NULL THEN quiet_now ELSE 0 END, CASE WHEN event IS NULL THEN silent_now ELSE 0 END,
    CASE WHEN event = 'speech_started' THEN list_max(levels_now) ELSE peak_now END,
    CASE WHEN event IN ('timed_out', 'speech_ended') THEN utterance + 1 ELSE utterance END,
    event, reason, end_limit, levels_now, quiet_now, silent_now, peak_now, utterance
  FROM (
    SELECT *, CASE WHEN phase = 'calibrating' AND len(levels_now) >= 3 THEN 'calibrated' WHEN phase = 'waiting' AND len(levels_now) >= 2 THEN 'speech_started'
        WHEN phase = 'waiting' AND waited + 1 >= 6 THEN 'timed_out' WHEN reason IS NOT NULL THEN 'speech_ended' END AS event,
      CASE WHEN len(heard) = 0 THEN -90::FLOAT ELSE {_MEDIAN.format('heard')} END AS calibrated
    FROM (
      SELECT *, list_filter(levels_now, lambda x: x > -120) AS heard,
        CASE WHEN phase = 'speaking' AND quiet_now >= 2 THEN 'silence' WHEN phase = 'speaking' AND elapsed + 1 >= 8 THEN 'maximum_duration' END AS reason
      FROM (
        SELECT session, w, phase, utterance, waited, elapsed, end_limit, greatest(peak, db) AS peak_now,
          CASE WHEN phase = 'speaking' AND db < end_limit THEN quiet + 1 ELSE 0 END AS quiet_now,
          CASE WHEN phase = 'speaking' AND db < end_limit THEN silent + 1 ELSE silent END AS silent_now,
          CASE WHEN phase = 'waiting' AND db < start_limit THEN [] WHEN phase = 'speaking' AND db < end_limit THEN levels ELSE list_append(levels, db) END AS levels_now,
          CASE WHEN phase = 'waiting' AND db < start_limit AND db > -120 THEN CAST((1::FLOAT - 0.02::FLOAT) * floor_db + 0.02::FLOAT * db AS FLOAT) ELSE floor_db END AS floor_now
        FROM (
          SELECT run.* EXCLUDE (w, event, reason, end_db, said, was_quiet, was_silent, top, of_utterance), win.w, db, greatest(floor_db + 1::FLOAT, -30::FLOAT) AS start_limit, greatest(floor_db + 0.5::FLOAT, -40::FLOAT) AS end_limit
          FROM run JOIN win ON win.session = run.session AND win.w = run.w + 1))))),
found AS (
  SELECT session, of_utterance AS utterance, event, w AS window_idx, (w + 1) * 2 AS at_frame, event = 'speech_ended' AS over, floor_db, reason, end_db, said, was_quiet, was_silent, top FROM run WHERE event IS NOT NULL),
told AS (
  SELECT session, utterance, event, window_idx, at_frame, CASE WHEN over THEN reason END AS end_reason, CASE WHEN over OR event = 'calibrated' THEN floor_db END AS noise_floor_dbfs,
    CASE WHEN over THEN greatest(floor_db + 1::FLOAT, -30::FLOAT) END AS start_threshold_dbfs, CASE WHEN over THEN end_db END AS end_threshold_dbfs, CASE WHEN over THEN top END AS peak_dbfs,
    CASE WHEN over THEN CAST(list_reduce(said, lambda a, x: CAST(a + x AS FLOAT)) / CAST(len(said) AS FLOAT) AS FLOAT) END AS mean_speech_dbfs, CASE WHEN over THEN {_MEDIAN.format('said')} END AS median_speech_dbfs,
    CASE WHEN over THEN len(said) + was_silent END AS detected_windows, CASE WHEN over THEN CAST(was_quiet AS BIGINT) END AS trailing_silence_windows,
    CASE WHEN over THEN len(said) END AS speech_windows, CASE WHEN over THEN CAST(was_silent AS BIGINT) END AS silence_windows FROM found)"""


_VAD_RUN = vad_run()

ORACLES: dict[str, str] = {
    "headline_counts": _with("""SELECT count(*) AS events, count(*) FILTER (windows >= 7) AS audio_samples, count(transcript) AS transcripts,
  count(*) FILTER (status = 'failed') AS processing_errors, count(*) FILTER (status = 'rejected' AND transcript IS NULL) AS short_rejections,
  count(*) FILTER (stored = 'no_speech') AS non_speech_annotations, count(current_intent) AS replayed_transcripts,
  count(*) FILTER (stored <> current_intent) AS changed_predictions, count(*) FILTER (stored = 'unknown' AND current_intent <> 'unknown') AS resolved_unknowns FROM ev"""),
    "grouped_counts": _with(" UNION ALL ".join(f"SELECT '{h}' AS heading, {c} AS name, count(*) AS n FROM ev WHERE {c} IS NOT NULL GROUP BY 1, 2" for h, c in _BLOCKS.items())),
    "status_counts": _counts("status", "status"),
    "intent_counts": _counts("stored", "intent"),
    "current_intents": _counts("current_intent", "intent"),
    "prediction_changes": _counts(_CHANGE, "change"),
    "device_counts": _counts(_DEVICE, "device"),
    "end_reason_counts": _counts("end_reason", "end_reason"),
    "event_distributions": _with(f"{_spread('metric', True)} FROM ({_values(('duration_ms', 'speech_windows', 'noise_floor_dbfs'), 'ev')}) WHERE v IS NOT NULL GROUP BY 1"),
    "value_distribution": f"{_spread('event_type', True)} FROM (SELECT event_type, value AS v FROM events) WHERE v IS NOT NULL GROUP BY 1",
    "vad_stats_by_truth": _with(f"{_spread('label_speech, metric', False)} FROM ({_values(tuple(_VAD), 'sam', 'speech AS label_speech, ')}) WHERE v IS NOT NULL GROUP BY 1, 2"),
    "latest_labels": _with("SELECT id AS event_id, speech AS actual_speech, label_text AS corrected_transcript, label_intent AS correct_intent, CAST(seq AS INTEGER) AS label_seq FROM lab"),
    "labeled_join": _with("SELECT id, event_id AS line_no, speech AS label_speech, label_text AS label_transcript, label_intent, historical, present AS current, transcript FROM sam"),
    "pending_review": _with("SELECT id, event_id AS line_no FROM ev WHERE id NOT IN (SELECT id FROM log)"),
    "review_queue": _with("""SELECT id, coalesce(transcript, '<no transcript>') AS shown_transcript, coalesce(stored, '<none>') AS shown_predicted,
  CASE WHEN current_intent <> coalesce(stored, '<none>') THEN current_intent END AS shown_current, coalesce(transcript IS NOT NULL AND stored <> 'no_speech', FALSE) AS default_speech,
  coalesce(transcript, '') AS default_transcript, coalesce(stored, 'unknown') AS default_intent FROM ev WHERE id NOT IN (SELECT id FROM log)"""),
    "review_summary": _with("SELECT count(*) FILTER (event_id % 3 = 0) AS saved, count(*) FILTER (event_id % 3 = 1) AS skipped, count(*) FILTER (event_id % 3 <> 0) AS remaining FROM ev WHERE id NOT IN (SELECT id FROM log)"),
    "source_counts": _with("SELECT count(*) FILTER (NOT prompted) AS natural, count(*) FILTER (prompted) AS prompted FROM sam"),
    "detection_eval": _with("""SELECT count(*) FILTER (speech) AS actual_speech, count(*) FILTER (NOT speech) AS actual_non_speech,
  count(*) FILTER (NOT speech AND transcript IS NULL AND status = 'rejected') AS non_speech_rejected_before_stt,
  count(*) FILTER (NOT speech AND transcript IS NOT NULL) AS non_speech_reached_stt, count(*) FILTER (NOT speech AND trim(transcript) <> '') AS non_speech_with_text,
  count(*) FILTER (NOT speech AND current_intent = 'no_speech') AS non_speech_annotations FROM sam"""),
    "safety_eval": _with("""SELECT *, historical_false_commands::DOUBLE / nullif(negative_samples, 0) AS historical_false_command_rate, current_false_commands::DOUBLE / nullif(negative_samples, 0) AS current_false_command_rate
FROM (SELECT count(*) AS negative_samples, count(*) FILTER (historical NOT IN ('unknown', 'no_speech')) AS historical_false_commands,
  count(*) FILTER (present NOT IN ('unknown', 'no_speech')) AS current_false_commands FROM sam WHERE NOT supported)"""),
    "safety_mistakes": _mistakes("NOT supported", "{0} NOT IN ('unknown', 'no_speech')", ""),
    "stt_eval": _with(f"""SELECT (SELECT count(*) FROM sam WHERE speech) AS speech_samples, count(*) AS evaluated_samples, count(*) FILTER (wer > 0) AS samples_with_errors,
  CAST(coalesce(sum(substitutions), 0) AS BIGINT) AS substitutions, CAST(coalesce(sum(deletions), 0) AS BIGINT) AS deletions, CAST(coalesce(sum(insertions), 0) AS BIGINT) AS insertions,
  CAST(coalesce(sum(reference_words), 0) AS BIGINT) AS reference_words, sum(substitutions + deletions + insertions)::DOUBLE / sum(reference_words)::DOUBLE AS aggregate_wer,
  round(avg(wer), 6) AS mean_sample_wer, median(wer) AS median_sample_wer FROM ({_ERRORS})"""),
    "wer_detail": _with(_ERRORS),
    "parser_accuracy_historical": _accuracy("historical"),
    "parser_accuracy_current": _accuracy("present"),
    "confusion_historical": _confusion("historical"),
    "confusion_current": _confusion("present"),
    "parser_mistakes": _mistakes("supported", "{0} <> label_intent", "label_intent AS expected, "),
    "threshold_sweep": _utterance_sweep("SELECT * FROM sweep", False),
    "threshold_sweep_offset": _utterance_sweep("SELECT * FROM sweep", True),
    "threshold_candidates": _utterance_sweep(_CANDIDATES, True),
    "threshold_candidates_none": _utterance_sweep(_CANDIDATES, False),
    "documents_sweep": f"WITH marked AS (SELECT quality = 1 AS good, n_chars FROM documents JOIN labels USING (doc_id)), {_sweep('marked', 'good', 'n_chars', 'generate_series(0, 20000, 1000)')} SELECT * FROM sweep",
    "timer_slots": _with(f"SELECT id, CAST(seconds AS BIGINT) AS seconds, {_SPOKEN} AS spoken FROM ev WHERE transcript IS NOT NULL AND seconds IS NOT NULL"),
    "timers": _with("SELECT id AS event_id, CAST(seconds AS BIGINT) AS duration_seconds, CAST(floor(epoch(ts)) AS BIGINT) + seconds AS fire_at FROM ev WHERE transcript IS NOT NULL AND seconds IS NOT NULL AND status = 'succeeded'"),
    "normalize_text": r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS normalized FROM documents",
    "prompt_eval": _with("""SELECT 'p-' || phrase_id AS prompt_id, bank_intent AS expected, count(*) AS events, count(*) FILTER (coalesce(stored, 'unknown') = bank_intent) AS historical_correct,
  count(*) FILTER (coalesce(current_intent, 'unknown') = bank_intent) AS current_correct FROM ev WHERE prompted GROUP BY 1, 2"""),
    "prompt_labels": _with("SELECT CAST(1 AS SMALLINT) AS schema_version, id AS event_id, TRUE AS actual_speech, corrected AS corrected_transcript, bank_intent AS correct_intent, CAST(NULL AS VARCHAR) AS notes FROM ev WHERE prompted"),
    "collection_summary": _with("""SELECT count(*) FILTER (done) AS collected, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (NOT done) AS remaining
FROM (SELECT phrase_id IN (SELECT phrase_id FROM ev WHERE prompted) AS done FROM bank WHERE bank_intent <> 'no_speech')"""),
    "built_events": _with(f"""SELECT id, audio_path, transcript, intent, CAST(CASE WHEN intent = 'set_timer' THEN seconds END AS VARCHAR) AS seconds, status,
  CASE WHEN status NOT IN ('succeeded', 'unsupported') THEN NULL WHEN intent = 'tell_time' THEN 'Сейчас ' || strftime(ts, '%H:%M') || '.' WHEN intent = 'play_music' THEN 'Открываю Spotify.'
    WHEN intent = 'set_timer' THEN 'Таймер установлен на ' || {_SPOKEN} || '.' ELSE 'Команда пока не поддерживается.' END AS response,
  CASE WHEN status = 'failed' THEN 'the action failed' END AS processing_error
FROM (SELECT *, CASE WHEN long_enough THEN 'audio/' || name || '.wav' END AS audio_path,
  CASE WHEN NOT long_enough THEN 'rejected' WHEN intent IS NULL THEN 'not_attempted' WHEN intent = 'no_speech' THEN 'rejected' WHEN prompted THEN 'not_attempted'
    WHEN event_id % 97 = 0 THEN 'failed' WHEN intent = 'unknown' THEN 'unsupported' ELSE 'succeeded' END AS status
  FROM (SELECT event_id, ts, prompted, seconds, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') || '-' || event_id AS name, name AS id, coalesce(speech_windows >= 7, FALSE) AS long_enough,
    CASE WHEN long_enough THEN ev.transcript END AS transcript, CASE WHEN long_enough THEN current_intent END AS intent FROM ev))"""),
    "level_windows": """SELECT session, window_idx, round(CAST(CAST(sqrt(s / 5) AS FLOAT) AS DOUBLE), 4) AS rms, round(CAST(CAST(20 * log10(CAST(CAST(sqrt(s / 5) AS FLOAT) AS DOUBLE)) AS FLOAT) AS DOUBLE), 3) AS dbfs, (window_idx + 1) * 5 AS end_frame
FROM (SELECT session, f // 5 AS window_idx, sum(x * x) AS s, count(*) AS n
  FROM (SELECT CAST(user_id AS VARCHAR) AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS f, value / 500 AS x FROM events) GROUP BY 1, 2) WHERE n = 5""",
    "vad_events": f"{_VAD_RUN} SELECT * FROM told",
    "vad_segments": f"""{_VAD_RUN} SELECT e.* EXCLUDE (event, at_frame), s.at_frame AS started_at, greatest(0, s.at_frame - 3) AS start_frame, e.at_frame AS end_frame
FROM told e JOIN told s USING (session, utterance) WHERE e.event = 'speech_ended' AND s.event = 'speech_started'""",
    "latest_per_user": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "unlabeled_documents": "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "label_confusion": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2",
}
