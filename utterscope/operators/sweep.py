"""Threshold sweeps: what a minimum duration keeps of speech and of noise, and which thresholds are candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = range(40, 501, 20)
RECALLS = (0.98, 0.95, 0.90)
CHECKPOINTS = (100, 140, 200, 300)


def threshold_sweep(observations: DataFrame, grid: Sequence[int] = GRID, positive: str = "label_speech", value: str = "duration_ms") -> DataFrame:
    """A row for each threshold, with or without observations: kept and rejected of each kind, recall and noise rejection.

    Observations are first counted by the grid step that they reach (with map-side sums), so that the
    grid is read off a table of at most 2 * (len(grid) + 1) rows.
    """
    steps = F.array(*[F.lit(t).cast("double") for t in grid])
    reached = F.size(F.filter(steps, lambda t: t <= F.col(value).cast("double")))
    counts = (
        observations.where(F.col(value).isNotNull() & F.col(positive).isNotNull())
        .groupBy(F.col(positive).alias("speech"), reached.alias("reached")).agg(F.count(F.lit(1)).alias("n"))
    )
    table = counts.agg(F.collect_list(F.struct("speech", "reached", "n")).alias("cells"))  # one row, empty or not
    each = table.select("cells", F.posexplode(F.array(*[F.lit(t).cast("long") for t in grid])).alias("step", "threshold_ms"))

    def total(speech: bool, kept: bool) -> Column:
        own = F.filter("cells", lambda c: (c["speech"] == speech) & ((c["reached"] > F.col("step")) == kept))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, c: a + c["n"])

    rows = each.select(
        "threshold_ms", total(True, True).alias("speech_kept"), total(True, False).alias("speech_rejected"),
        total(False, True).alias("non_speech_kept"), total(False, False).alias("non_speech_rejected"),
    )
    return rows.withColumn(
        "speech_recall", F.try_divide(F.col("speech_kept").cast("double"), (F.col("speech_kept") + F.col("speech_rejected")).cast("double"))
    ).withColumn("noise_rejection_rate", F.try_divide(F.col("non_speech_rejected").cast("double"), (F.col("non_speech_kept") + F.col("non_speech_rejected")).cast("double")))


def candidate_thresholds(sweep: DataFrame, recalls: Sequence[float] = RECALLS) -> DataFrame:
    """The largest threshold that keeps each recall, where there is noise to reject; each once."""
    wanted = F.explode(F.array(*[F.lit(r) for r in recalls]))
    good = sweep.where("noise_rejection_rate is not null").withColumn("least", wanted).where("speech_recall >= least")
    return good.groupBy("least").agg(F.max("threshold_ms").alias("threshold_ms")).select("threshold_ms").distinct()
