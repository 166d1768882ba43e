"""Controlled collection: events of prompts, their labels and how far a plan has come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.schema import LABEL_VERSION


def with_prompt(events: DataFrame, plan: DataFrame) -> DataFrame:
    """Events with their prompt's metadata as `collection`; `prompt_id` names the prompt. A plan is a small dimension."""
    p = plan.select(
        F.col("prompt_id").alias("__prompt"),
        F.struct(F.lit("prompted").alias("source"), "campaign", "prompt_id", F.col("transcript").alias("expected_transcript"), F.col("intent").alias("expected_intent")).alias("__collection"),
    )
    joined = events.join(p, F.col("prompt_id") == F.col("__prompt"), "left")
    return joined.drop("__prompt", *(["collection"] if "collection" in events.columns else [])).withColumnRenamed("__collection", "collection")


def prompt_labels(events: DataFrame) -> DataFrame:
    """The automatic label of each prompted event, rejected and failed ones too: speech, as the prompt has it."""
    return events.where("collection is not null").select(
        F.lit(LABEL_VERSION).cast("smallint").alias("schema_version"), F.col("id").alias("event_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX").alias("labeled_at"), F.lit(True).alias("actual_speech"),
        F.col("collection.expected_transcript").alias("corrected_transcript"), F.col("collection.expected_intent").alias("correct_intent"), F.lit(None).cast("string").alias("notes"),
    )


def prompt_evaluation(replayed_events: DataFrame) -> DataFrame:
    """prompt_id, expected, events, and how many stored and replayed predictions were as expected."""
    c = F.col("collection")
    return replayed_events.where("collection is not null").groupBy(c["prompt_id"].alias("prompt_id"), c["expected_intent"].alias("expected")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.coalesce("prediction.intent", F.lit("unknown")) == c["expected_intent"]).alias("historical_correct"),
        F.count_if(F.coalesce("current_intent", F.lit("unknown")) == c["expected_intent"]).alias("current_correct"),
    )


def collection_summary(plan: DataFrame, events: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """collected, skipped and remaining prompts of a plan."""
    done = events.where("collection is not null").select(F.col("collection.prompt_id").alias("prompt_id")).distinct().withColumn("done", F.lit(True))
    met = plan.select("prompt_id").join(done, "prompt_id", "left")
    if skipped is not None:
        met = met.join(skipped.select("prompt_id").distinct().withColumn("left_out", F.lit(True)), "prompt_id", "left")
    else:
        met = met.withColumn("left_out", F.lit(None).cast("boolean"))
    return met.agg(
        F.count("done").alias("collected"), F.count_if(F.col("done").isNull() & F.col("left_out").isNotNull()).alias("skipped"),
        F.count_if(F.col("done").isNull() & F.col("left_out").isNull()).alias("remaining"),
    )
