"""The review queue: events without a label, defaults for a reviewer, and decisions turned into labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.functions.intent import with_intent
from utterscope.schema import LABEL_VERSION

#: What a reviewer may decide about an event.
DECISIONS = ("save", "skip")


def pending(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events whose id has no label; order by their place to get the queue."""
    return events.join(labels.select(F.col("event_id").alias("__event")), F.col("id") == F.col("__event"), "left_anti")


def review_queue(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Pending events with what is shown of them and the defaults of the questions.

    `shown_current` is the parser's answer where it differs from what is shown as the stored one.
    """
    queue = with_intent(pending(events, labels), "transcript")
    predicted = F.coalesce("prediction.intent", F.lit("<none>"))
    return (
        queue.withColumn("shown_transcript", F.coalesce("transcript", F.lit("<no transcript>")))
        .withColumn("shown_predicted", predicted)
        .withColumn("shown_current", F.when(F.col("current_intent") != predicted, F.col("current_intent")))
        .withColumn("default_speech", F.coalesce(F.col("transcript").isNotNull() & (F.col("prediction.intent") != "no_speech"), F.lit(False)))
        .withColumn("default_transcript", F.coalesce("transcript", F.lit("")))
        .withColumn("default_intent", F.coalesce("prediction.intent", F.lit("unknown")))
    )


def apply_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Labels of the saved decisions.

    `decisions` has event_id, action (save or skip) and, null for the default, actual_speech, corrected_transcript,
    correct_intent and notes. Events of non-speech have no transcript and the intent no_speech; empty notes are none.
    """
    d = decisions.where(F.col("action") == "save").select(*[F.col(c).alias(f"__{c}") for c in ("event_id", "actual_speech", "corrected_transcript", "correct_intent", "notes")])
    joined = queue.join(d, F.col("id") == F.col("__event_id"))
    speech = F.coalesce("__actual_speech", "default_speech")
    return joined.select(
        F.lit(LABEL_VERSION).cast("smallint").alias("schema_version"), F.col("id").alias("event_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX").alias("labeled_at"), speech.alias("actual_speech"),
        F.when(speech, F.coalesce("__corrected_transcript", "default_transcript")).alias("corrected_transcript"),
        F.when(speech, F.coalesce("__correct_intent", "default_intent")).otherwise("no_speech").alias("correct_intent"),
        F.when(F.col("__notes") != "", F.col("__notes")).alias("notes"),
    )


def review_summary(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """saved, skipped and remaining; skipped events remain."""
    ids = queue.select(F.col("id").alias("event_id"))
    met = ids.join(decisions.select("event_id", "action"), "event_id", "left")
    return met.agg(
        F.count_if(F.col("action") == "save").alias("saved"), F.count_if(F.col("action") == "skip").alias("skipped"),
        F.count_if(~F.coalesce(F.col("action") == "save", F.lit(False))).alias("remaining"),
    )
