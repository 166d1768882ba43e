"""Counts and evaluations over events and their latest labels.

`samples` is what `labelled` returns: events joined to their label, with the parser replayed once, so that each evaluation
is one aggregate over plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.functions.intent import with_intent
from utterscope.functions.stats import distribution
from utterscope.functions.text import trimmed, words
from utterscope.functions.wer import rate, word_errors
from utterscope.schema import LEVEL_WINDOW_MS, VAD_METRICS

NOT_ACTIONABLE = ("unknown", "no_speech")


def replayed(events: DataFrame) -> DataFrame:
    """Add current_intent, the parser's answer to the stored transcript; null without one."""
    return with_intent(events, "transcript")


def labelled(replayed_events: DataFrame, latest: DataFrame) -> DataFrame:
    """Events with a label: an inner join from the events' side, every event of a repeated id kept.

    Columns: the event's, and label_speech, label_transcript, label_intent, historical and current (unknown for null).
    """
    label = latest.select(
        F.col("event_id").alias("__event"), F.col("actual_speech").alias("label_speech"),
        F.col("corrected_transcript").alias("label_transcript"), F.col("correct_intent").alias("label_intent"),
    )
    joined = replayed_events.join(label, F.col("id") == F.col("__event")).drop("__event")
    return joined.withColumn("historical", F.coalesce("prediction.intent", F.lit("unknown"))).withColumn("current", F.coalesce("current_intent", F.lit("unknown")))


def actionable(intent: Column) -> Column:
    return ~intent.isin(*NOT_ACTIONABLE)


def supported_command() -> Column:
    return F.col("label_speech") & actionable(F.col("label_intent"))


def negative() -> Column:
    return ~supported_command()


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def headline_counts(replayed_events: DataFrame) -> DataFrame:
    stored, current = F.col("prediction.intent"), F.col("current_intent")
    changed = stored.isNotNull() & current.isNotNull() & (stored != current)
    return replayed_events.agg(
        F.count(F.lit(1)).alias("events"),
        F.count("audio_path").alias("audio_samples"),
        F.count("transcript").alias("transcripts"),
        F.count("processing_error").alias("processing_errors"),
        F.count_if((F.col("execution_result.status") == "rejected") & F.col("transcript").isNull()).alias("short_rejections"),
        F.count_if(stored == "no_speech").alias("non_speech_annotations"),
        F.count("current_intent").alias("replayed_transcripts"),
        F.count_if(changed).alias("changed_predictions"),
        F.count_if(changed & (stored == "unknown")).alias("resolved_unknowns"),
    )


def grouped_counts(replayed_events: DataFrame) -> DataFrame:
    """(heading, name, n) of all six count blocks in one pass: rows are unpivoted, then counted with map-side sums."""
    stored, current = F.col("prediction.intent"), F.col("current_intent")
    keys = {
        "execution_statuses": F.col("execution_result.status"),
        "stored_intents": stored,
        "current_intents": current,
        "prediction_changes": F.when(stored != current, F.concat_ws(" -> ", stored, current)),
        "devices": trimmed(F.col("input.device")),
        "end_reasons": F.col("vad.end_reason"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("heading"), v.alias("name")) for k, v in keys.items()]))
    return replayed_events.select(pairs.alias("x")).select("x.*").where("name is not null").groupBy("heading", "name").agg(F.count(F.lit(1)).alias("n"))


def event_distributions(events: DataFrame) -> DataFrame:
    """metric, count, minimum, median, percentile_95, mean and maximum over all events."""
    return distribution(_metrics(events, ("duration_ms", "speech_windows", "noise_floor_dbfs"), ()), ["metric"], "value")


def vad_statistics(samples: DataFrame) -> DataFrame:
    """label_speech, metric, count, minimum, median, mean and maximum of the eight detector metrics."""
    return distribution(_metrics(samples, VAD_METRICS, ("label_speech",)), ["label_speech", "metric"], "value").drop("percentile_95")


def _metrics(df: DataFrame, names: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"vad.{m}").cast("double").alias("value")) for m in names]))
    return df.select(*keep, each.alias("x")).select(*keep, "x.*")


def source_counts(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count_if(F.col("collection").isNull()).alias("natural"), F.count("collection").alias("prompted"))


def detection(samples: DataFrame) -> DataFrame:
    silent, transcript = ~F.col("label_speech"), F.col("transcript")
    return samples.agg(
        F.count_if(F.col("label_speech")).alias("actual_speech"),
        F.count_if(silent).alias("actual_non_speech"),
        F.count_if(silent & transcript.isNull() & (F.col("execution_result.status") == "rejected")).alias("non_speech_rejected_before_stt"),
        F.count_if(silent & transcript.isNotNull()).alias("non_speech_reached_stt"),
        F.count_if(silent & (trimmed(transcript) != "")).alias("non_speech_with_text"),
        F.count_if(silent & (F.col("current_intent") == "no_speech")).alias("non_speech_annotations"),
    )


def safety(samples: DataFrame) -> DataFrame:
    counted = samples.where(negative()).agg(
        F.count(F.lit(1)).alias("negative_samples"),
        F.count_if(actionable(F.col("historical"))).alias("historical_false_commands"),
        F.count_if(actionable(F.col("current"))).alias("current_false_commands"),
    )
    for name in ("historical", "current"):
        counted = counted.withColumn(f"{name}_false_command_rate", _share(F.col(f"{name}_false_commands"), F.col("negative_samples")))
    return counted


def _both(samples: DataFrame, *columns: str) -> DataFrame:
    """Each sample once for the stored and once for the replayed prediction."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("parser"), F.col(p).alias("predicted")) for p in ("historical", "current")]))
    return samples.select(*columns, each.alias("x")).select(*columns, "x.*")


def safety_mistakes(samples: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """parser, event_id, predicted, transcript and `keep` of every false command."""
    rows = _both(samples.where(negative()), "id", "transcript", *keep).where(actionable(F.col("predicted")))
    return rows.select("parser", F.col("id").alias("event_id"), "predicted", F.coalesce("transcript", F.lit("")).alias("transcript"), *keep)


def parser_accuracy(samples: DataFrame, parser: str) -> DataFrame:
    """correct, total and accuracy of `historical` or `current` on supported commands."""
    counted = samples.where(supported_command()).agg(F.count_if(F.col(parser) == F.col("label_intent")).alias("correct"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("accuracy", _share(F.col("correct"), F.col("total")))


def confusion(samples: DataFrame, parser: str) -> DataFrame:
    return samples.where(supported_command()).groupBy(F.col("label_intent").alias("expected"), F.col(parser).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def parser_mistakes(samples: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """parser, event_id, expected, predicted, transcript and `keep` of every wrong prediction."""
    rows = _both(samples.where(supported_command()), "id", "label_intent", "transcript", *keep).where("predicted <> label_intent")
    text = F.coalesce("transcript", F.lit("")).alias("transcript")
    return rows.select("parser", F.col("id").alias("event_id"), F.col("label_intent").alias("expected"), "predicted", text, *keep)


def _with_errors(pairs: DataFrame, *keep: str) -> DataFrame:
    """Word errors of label_transcript against transcript; null for pairs without a reference or any word in it."""
    tokens = (
        pairs.select(*keep, words(F.col("label_transcript")).alias("reference"), words(F.coalesce("transcript", F.lit(""))).alias("hypothesis"))
        .withColumn("e", F.when(F.size("reference") > 0, word_errors(F.col("reference"), F.col("hypothesis"))))
    )
    return tokens.select(
        *keep, F.col("e.s").alias("substitutions"), F.col("e.d").alias("deletions"), F.col("e.i").alias("insertions"),
        F.when(F.col("e").isNotNull(), F.size("reference")).alias("reference_words"), rate(F.col("e.c"), F.size("reference")).alias("wer"),
    )


def sample_errors(samples: DataFrame) -> DataFrame:
    """event_id, substitutions, deletions, insertions, reference_words and wer of the speech samples with a reference.

    Equal pairs of texts are aligned once.
    """
    texts = ("label_transcript", "transcript")
    referenced = samples.where(F.col("label_speech") & F.col("label_transcript").isNotNull())
    aligned = _with_errors(referenced.select(*texts).distinct(), *texts).where("reference_words is not null")
    same = F.col("label_transcript").eqNullSafe(F.col("__l")) & F.col("transcript").eqNullSafe(F.col("__t"))
    pairs = aligned.select(F.col("label_transcript").alias("__l"), F.col("transcript").alias("__t"), *[c for c in aligned.columns if c not in texts])
    return referenced.select(F.col("id").alias("event_id"), *texts).join(pairs, same).drop(*texts, "__l", "__t")


def stt(samples: DataFrame) -> DataFrame:
    """One row: speech_samples, evaluated_samples, samples_with_errors, the sums of errors and words, and three WERs.

    Commands repeat, so equal pairs of texts are counted first and aligned once; all figures are one aggregate over a row
    for each outcome, and the exact median keeps the distinct rates only.
    """
    names = ("substitutions", "deletions", "insertions", "reference_words")
    pairs = samples.where("label_speech").groupBy("label_transcript", "transcript").agg(F.count(F.lit(1)).alias("n"))
    outcomes = _with_errors(pairs, "n").groupBy(*names, "wer").agg(F.sum("n").alias("n"))
    n, edits = F.col("n"), F.col("substitutions") + F.col("deletions") + F.col("insertions")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    one = outcomes.agg(
        total(n).alias("speech_samples"), total(F.when(F.col("wer").isNotNull(), n)).alias("evaluated_samples"), total(F.when(edits > 0, n)).alias("samples_with_errors"),
        *[total(F.col(c) * n).alias(c) for c in names],
        F.sum(F.col("wer") * n).alias("__wer"), F.percentile("wer", F.lit(0.5), n).alias("median_sample_wer"),
    )
    one = one.withColumn("aggregate_wer", rate(edits, F.col("reference_words"))).withColumn("mean_sample_wer", rate(F.col("__wer"), F.col("evaluated_samples")))
    return one.select("speech_samples", "evaluated_samples", "samples_with_errors", *names, "aggregate_wer", "mean_sample_wer", "median_sample_wer")


def speech_durations(samples: DataFrame) -> DataFrame:
    """label_speech and simulated duration_ms: speech windows times the window length on record, 20 ms without one."""
    windows = F.col("vad.speech_windows")
    length = F.coalesce(F.col("provenance.vad_config.level_window_ms"), F.lit(LEVEL_WINDOW_MS))
    return samples.where(windows.isNotNull()).select("label_speech", (windows * length).alias("duration_ms"))
