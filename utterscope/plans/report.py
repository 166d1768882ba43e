"""The dataset report as lines of text, from result frames.

All computing is in the frames; what comes to the driver are counts and statistics, and the mistakes, which are streamed in the
order of their places. With `max_cases` a list of mistakes ends there, with a line that says how many are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession

from utterscope.functions.spoken import rate_text
from utterscope.operators import evaluate, sweep
from utterscope.schema import VAD_METRICS
from utterscope.sources.jsonl import PLACE, latest_labels, read_events, read_labels

# The report's labels, in its order.
HEADLINES = (
    ("Events", "events"), ("Audio samples", "audio_samples"), ("Transcripts", "transcripts"), ("Processing errors", "processing_errors"),
    ("Short rejections", "short_rejections"), ("Whisper non-speech annotations", "non_speech_annotations"), ("Replayed transcripts", "replayed_transcripts"),
    ("Changed predictions", "changed_predictions"), ("Resolved historical unknowns", "resolved_unknowns"),
)
DETECTION = (
    ("Actual speech", "actual_speech"), ("Actual non-speech / false activations", "actual_non_speech"), ("Non-speech rejected before Whisper", "non_speech_rejected_before_stt"),
    ("Non-speech that reached Whisper", "non_speech_reached_stt"), ("Non-speech with non-empty Whisper text", "non_speech_with_text"),
    ("Non-speech recognized as sound annotations", "non_speech_annotations"),
)
BLOCKS = (
    ("Execution", "execution_statuses"), ("Stored intents", "stored_intents"), ("Current parser intents", "current_intents"),
    ("Prediction changes", "prediction_changes"), ("Input devices", "devices"), ("VAD end reasons", "end_reasons"),
)
METRICS = {
    "duration_ms": ("duration", "ms"), "speech_windows": ("speech windows", ""), "peak_dbfs": ("peak", "dBFS"), "mean_speech_dbfs": ("mean speech level", "dBFS"),
    "median_speech_dbfs": ("median speech level", "dBFS"), "noise_floor_dbfs": ("noise floor", "dBFS"), "start_threshold_dbfs": ("start threshold", "dBFS"),
    "end_threshold_dbfs": ("end threshold", "dBFS"),
}


def _statistics(metric: str, row: Row | None, fields: Iterable[str], counted: bool) -> str:
    name, unit = METRICS[metric]
    if row is None:
        return f"  {name}: no data"
    tail = f" {unit}" if unit else ""
    shown = ([str(row["count"])] if counted else []) + [f"{row[f]:.1f}{tail}" for f in fields]
    return f"  {name}: {' / '.join(shown)}"


def _cases(mistakes: DataFrame, parser: str, limit: int | None, line: Callable[[Row], str]) -> Iterator[str]:
    rows = mistakes.where(mistakes["parser"] == parser)
    ordered = rows.orderBy(*PLACE)
    for row in (ordered if limit is None else ordered.limit(limit)).toLocalIterator():
        yield line(row)
    left = 0 if limit is None else rows.count() - limit
    if left > 0:
        yield f"    (and {left} more)"


def _parser(heading: str, accuracy: Row, confusion: list[Row], mistakes: Iterator[str]) -> Iterator[str]:
    yield from ("", f"{heading} (supported labeled commands only):")
    yield f"  Correct: {accuracy['correct']} / {accuracy['total']} ({rate_text(accuracy['accuracy'])})"
    yield "  Confusion (expected -> predicted):"
    yield from [f"    {r['expected']} -> {r['predicted']}: {r['n']}" for r in confusion] or ["    (no data)"]
    yield "  Errors:"
    first = next(mistakes, None)
    yield "    (none)" if first is None else first
    yield from mistakes


def _threshold(row: Row, candidates: set[int]) -> str:
    t = row["threshold_ms"]
    mark = ("*" if t in sweep.CHECKPOINTS else " ") + ("!" if t in candidates else " ")
    kept = f"{row['speech_kept']:>3}/{row['speech_rejected']:<3}             {row['non_speech_kept']:>3}/{row['non_speech_rejected']:<3}"
    return f"  {mark} {t:>3} ms      {kept}          {rate_text(row['speech_recall']):>6}  {rate_text(row['noise_rejection_rate']):>6}"


def report_lines(events: DataFrame, latest: DataFrame, max_cases: int | None = None) -> Iterator[str]:
    """The report of events (with their place) and latest labels."""
    replayed = evaluate.replayed(events).persist(StorageLevel.MEMORY_AND_DISK)
    samples = evaluate.labelled(replayed, latest).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield from _lines(replayed, samples, max_cases)
    finally:
        samples.unpersist()
        replayed.unpersist()


def render(events: DataFrame, latest: DataFrame, max_cases: int | None = None) -> str:
    return "\n".join(report_lines(events, latest, max_cases))


def _lines(replayed: DataFrame, samples: DataFrame, max_cases: int | None) -> Iterator[str]:
    head = evaluate.headline_counts(replayed).first()
    out = [f"{label}: {head[c]}" for label, c in HEADLINES]
    sources = evaluate.source_counts(samples).first()
    out += ["", f"Labeled pipeline evaluation: {sources['natural'] + sources['prompted']} / {head['events']}", f"  Natural samples: {sources['natural']}", f"  Prompted samples: {sources['prompted']}"]

    safe, wrong = evaluate.safety(samples).first(), evaluate.safety_mistakes(samples, PLACE)
    out += ["", "False command safety:", f"  Negative samples (non-speech or unsupported speech): {safe['negative_samples']}"]
    for parser, label in (("historical", "Historical false commands"), ("current", "Current parser false commands")):
        out.append(f"  {label}: {safe[f'{parser}_false_commands']} / {safe['negative_samples']} ({rate_text(safe[f'{parser}_false_command_rate'])})")
        if safe[f"{parser}_false_commands"]:
            out.append(f"  {parser.title()} false-command cases:")
            yield from out
            out = []
            yield from _cases(wrong, parser, max_cases, lambda r: f"    {r['event_id']}: {r['predicted']} | \"{r['transcript']}\"")

    detected = evaluate.detection(samples).first()
    out += ["", "Speech detection:", *[f"  {label}: {detected[c]}" for label, c in DETECTION]]
    stt = evaluate.stt(samples).first()
    out += [
        "", "Whisper (actual speech only):", f"  Speech samples: {stt['speech_samples']}", f"  Samples evaluated: {stt['evaluated_samples']}", f"  Samples with word errors: {stt['samples_with_errors']}",
        f"  Word errors (substitutions / deletions / insertions): {stt['substitutions']} / {stt['deletions']} / {stt['insertions']}",
        f"  Aggregate WER: {rate_text(stt['aggregate_wer'])}", f"  Mean per-sample WER: {rate_text(stt['mean_sample_wer'])}", f"  Median per-sample WER: {rate_text(stt['median_sample_wer'])}",
    ]
    yield from out
    mistakes = evaluate.parser_mistakes(samples, PLACE)
    for parser, heading in (("historical", "Historical parser"), ("current", "Current parser")):
        matrix = evaluate.confusion(samples, parser).orderBy("expected", "predicted").collect()
        cases = _cases(mistakes, parser, max_cases, lambda r: f"    {r['event_id']}: {r['expected']} -> {r['predicted']} | \"{r['transcript']}\"")
        yield from _parser(heading, evaluate.parser_accuracy(samples, parser).first(), matrix, cases)

    out = []
    spread = {(r["label_speech"], r["metric"]): r for r in evaluate.vad_statistics(samples).collect()}
    for speech, what in ((True, "actual speech"), (False, "actual non-speech")):
        out += ["", f"VAD telemetry — {what} (count / min / median / mean / max):"]
        out += [_statistics(m, spread.get((speech, m)), ("minimum", "median", "mean", "maximum"), True) for m in VAD_METRICS]

    swept = sweep.threshold_sweep(evaluate.speech_durations(samples))
    rows = swept.orderBy("threshold_ms").collect()
    candidates = sorted(r["threshold_ms"] for r in sweep.candidate_thresholds(swept).collect())
    out += ["", "Minimum speech duration simulation:", "  mark threshold  speech kept/rejected  noise kept/rejected  recall  noise rejection"]
    out += [_threshold(r, set(candidates)) for r in rows]
    out.append("  * requested checkpoint; ! data-based candidate")
    out.append(f"  Candidates: {', '.join(f'{c} ms' for c in candidates)} (configuration unchanged)" if candidates else "  Candidates: no labeled VAD data")

    blocks: dict[str, list[Row]] = {}
    for r in evaluate.grouped_counts(replayed).orderBy("name").collect():
        blocks.setdefault(r["heading"], []).append(r)
    for label, heading in BLOCKS:
        out += ["", f"{label}:", *([f"  {r['name']}: {r['n']}" for r in blocks.get(heading, [])] or ["  (no data)"])]
    whole = {r["metric"]: r for r in evaluate.event_distributions(replayed).collect()}
    out += ["", "VAD distributions (min / median / p95 / max):"]
    yield from out + [_statistics(m, whole.get(m), ("minimum", "median", "percentile_95", "maximum"), False) for m in ("duration_ms", "speech_windows", "noise_floor_dbfs")]


def dataset_report(
    spark: SparkSession, events_path: str, labels_path: str, producer_version: str = "app_version", max_cases: int | None = None
) -> Iterator[str]:
    events = read_events(spark, events_path, producer_version)
    yield f"Dataset: {events_path}"
    yield from report_lines(events, latest_labels(read_labels(spark, labels_path)), max_cases)
