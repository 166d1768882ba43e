"""The named queries, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.functions.intent import with_intent
from utterscope.functions.spoken import duration_text
from utterscope.functions.stats import distribution
from utterscope.functions.text import normalized
from utterscope.operators import collect, evaluate, levels, process, review, sweep, vad
from utterscope.plans import adapter
from utterscope.sources.jsonl import latest_labels

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.replayed(adapter.events(spark, sf_dir))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_labels(adapter.labels(spark, sf_dir), ["label_seq"])


def _samples(spark: SparkSession, sf_dir: str, offset: bool = False) -> DataFrame:
    return evaluate.labelled(evaluate.replayed(adapter.events(spark, sf_dir, offset)), _latest(spark, sf_dir))


def _over(source: Callable, operator: Callable[..., DataFrame], *more) -> Query:
    return lambda spark, sf_dir: operator(source(spark, sf_dir), *more)


def _block(heading: str, name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate.grouped_counts(_replayed(spark, sf_dir)).where(F.col("heading") == heading).select(F.col("name").alias(name), "n")

    return query


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _event_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.event_distributions(adapter.events(spark, sf_dir)), "mean")


def _vad_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.vad_statistics(_samples(spark, sf_dir)), "mean")


def _value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(distribution(_table(spark, sf_dir, "events"), ["event_type"], "value"), "mean")


def _stt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.stt(_samples(spark, sf_dir)), "mean_sample_wer")


def _latest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select("event_id", "actual_speech", "corrected_transcript", "correct_intent", "label_seq")


def _labelled_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("id", "line_no", "label_speech", "label_transcript", "label_intent", "historical", "current", "transcript")


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.pending(adapter.events(spark, sf_dir), adapter.labels(spark, sf_dir)).select("id", "line_no")


def _review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = review.review_queue(adapter.events(spark, sf_dir), adapter.labels(spark, sf_dir))
    return queue.select("id", "shown_transcript", "shown_predicted", "shown_current", "default_speech", "default_transcript", "default_intent")


def _review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = review.review_queue(adapter.events(spark, sf_dir), adapter.labels(spark, sf_dir))
    decisions = queue.select(F.col("id").alias("event_id"), F.expr("case when line_no % 3 = 0 then 'save' when line_no % 3 = 1 then 'skip' end").alias("action"))
    return review.review_summary(queue, decisions.where("action is not null"))


def _sweep(offset: bool) -> Query:
    return lambda spark, sf_dir: sweep.threshold_sweep(evaluate.speech_durations(_samples(spark, sf_dir, offset)))


def _candidates(offset: bool) -> Query:
    return lambda spark, sf_dir: sweep.candidate_thresholds(_sweep(offset)(spark, sf_dir))


def _documents_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which least length keeps how many documents of good and of bad quality."""
    marked = _table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    return sweep.threshold_sweep(marked, range(0, 20_001, 1000), "good", "n_chars")


def _timer_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = with_intent(adapter.events(spark, sf_dir), "transcript", "current_intent", "seconds")
    return parsed.where("seconds is not null").select("id", "seconds", duration_text(F.col("seconds")).alias("spoken"))


def with_timer_slots(events: DataFrame) -> DataFrame:
    """Events with the replayed command and its duration as their prediction."""
    parsed = with_intent(events, "transcript", "intent", "seconds")
    slots = F.create_map(F.lit("duration_seconds"), F.col("seconds").cast("string"))
    return parsed.withColumn("prediction", F.struct("intent", slots.alias("slots")))


def _timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers that the replayed commands would set."""
    return process.timers(with_timer_slots(adapter.events(spark, sf_dir))).select("event_id", "duration_seconds", F.unix_timestamp("fire_at").alias("fire_at"))


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text")).alias("normalized"))


def _collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.collection_summary(adapter.plan(spark), adapter.events(spark, sf_dir))


def _prompt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.prompt_labels(adapter.events(spark, sf_dir)).drop("labeled_at")


def _built_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events built from captured utterances: gate, command, result."""
    e = adapter.events(spark, sf_dir)
    captured = e.select(
        F.col("timestamp").alias("id_time"), F.col("line_no").cast("string").alias("id_suffix"), "provenance", "collection", F.col("input.device").alias("device"),
        F.col("input.sample_rate_hz").alias("sample_rate_hz"), F.col("input.channels").alias("channels"), "transcript", F.lit(None).cast("string").alias("processing_error"),
        F.when(F.expr("line_no % 97 = 0"), "the action failed").alias("action_error"), "vad", "moment",
    )
    built = process.build_events(captured)
    return built.select("id", "audio_path", "transcript", F.col("prediction.intent").alias("intent"), F.col("prediction.slots")["duration_seconds"].alias("seconds"), F.col("execution_result.status").alias("status"), F.col("execution_result.response").alias("response"), "processing_error")


#: Ids that are numbered together.
RANGE = 1 << 16


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as mono frames: their values, in the order of their ids, scaled to full scale.

    A user's events are numbered by ranges of ids, each shifted by the counts of those before it, so that no task has a user.
    """
    from pyspark.sql.window import Window

    span = F.floor(F.col("event_id") / RANGE).alias("span")
    e = _table(spark, sf_dir, "events").select("user_id", span, "event_id", (F.col("value") / 500).alias("x"))
    before = Window.partitionBy("user_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    shift = e.groupBy("user_id", "span").agg(F.count(F.lit(1)).alias("n")).select("user_id", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("user_id", "span").orderBy("event_id")
    placed = e.join(shift, (e["user_id"].eqNullSafe(shift["user_id"])) & (e["span"].eqNullSafe(shift["span"]))).drop(shift["user_id"], shift["span"])
    return placed.select(F.col("user_id").cast("string").alias("session"), (F.col("shift") + F.row_number().over(within) - 1).alias("frame"), "x")


def _level_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.levels_of_frames(_frames(spark, sf_dir), ["session"], "frame", "x", 5).select("session", "window_idx", F.round(F.col("rms").cast("double"), 4).alias("rms"), F.round(F.col("dbfs").cast("double"), 3).alias("dbfs"), F.col("end_frame").cast("bigint").alias("end_frame"))


#: A detector for few and short windows.
SMALL = vad.VadConfig(3, 2, 2, 6, 8, 1.0, 0.5, -30.0, -40.0, 0.02)


def _vad_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vad.detect(levels.levels_of_frames(_frames(spark, sf_dir), ["session"], "frame", "x", 2), "session", SMALL)


def _vad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vad.segments(_vad_events(spark, sf_dir), 10)


def _latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")


def _unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang", "source")


def _label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Query] = {
    "headline_counts": _over(_replayed, evaluate.headline_counts),
    "grouped_counts": _over(_replayed, evaluate.grouped_counts),
    "status_counts": _block("execution_statuses", "status"),
    "intent_counts": _block("stored_intents", "intent"),
    "current_intents": _block("current_intents", "intent"),
    "prediction_changes": _block("prediction_changes", "change"),
    "device_counts": _block("devices", "device"),
    "end_reason_counts": _block("end_reasons", "end_reason"),
    "event_distributions": _event_distributions,
    "value_distribution": _value_distribution,
    "vad_stats_by_truth": _vad_stats,
    "latest_labels": _latest_labels,
    "labeled_join": _labelled_join,
    "pending_review": _pending,
    "review_queue": _review_queue,
    "review_summary": _review_summary,
    "source_counts": _over(_samples, evaluate.source_counts),
    "detection_eval": _over(_samples, evaluate.detection),
    "safety_eval": _over(_samples, evaluate.safety),
    "safety_mistakes": _over(_samples, evaluate.safety_mistakes),
    "stt_eval": _stt,
    "wer_detail": _over(_samples, evaluate.sample_errors),
    "parser_accuracy_historical": _over(_samples, evaluate.parser_accuracy, "historical"),
    "parser_accuracy_current": _over(_samples, evaluate.parser_accuracy, "current"),
    "confusion_historical": _over(_samples, evaluate.confusion, "historical"),
    "confusion_current": _over(_samples, evaluate.confusion, "current"),
    "parser_mistakes": _over(_samples, evaluate.parser_mistakes),
    "threshold_sweep": _sweep(False),
    "threshold_sweep_offset": _sweep(True),
    "threshold_candidates": _candidates(True),
    "threshold_candidates_none": _candidates(False),
    "documents_sweep": _documents_sweep,
    "timer_slots": _timer_slots,
    "timers": _timers,
    "normalize_text": _normalized,
    "prompt_eval": _over(_replayed, collect.prompt_evaluation),
    "prompt_labels": _prompt_labels,
    "collection_summary": _collection_summary,
    "built_events": _built_events,
    "level_windows": _level_windows,
    "vad_events": _vad_events,
    "vad_segments": _vad_segments,
    "latest_per_user": _latest_per_user,
    "unlabeled_documents": _unlabelled_documents,
    "label_confusion": _label_confusion,
}
