"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import remove, stored


#: Edges of a task, at most so many tasks being made as there are cores or these ask for.
TASK_EDGES = 200_000


def _least(edges: DataFrame, tasks: int) -> tuple[DataFrame, str]:
    """(u, m) with m the smallest neighbour of u, materialised: so a join with the edges can split a hot u."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")


def _stars(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v, m) with m the smallest of u and its neighbours v."""
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    `edges` has long columns u and v; direction, repeats and loops don't matter. Each step is a table in the shared folder
    (unlike a checkpoint, it hands no constraints on to the next plan), and those of earlier rounds are deleted. Rounds end
    when the edge table (its count and the sum of its rows' hashes) no longer changes.
    """
    spark = edges.sparkSession
    now, path = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        tasks = max(spark.sparkContext.defaultParallelism, state[0] // TASK_EDGES)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, used = _least(both, tasks)
        large, more = stored(_stars(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks), "large")
        least, last = _least(large, tasks)
        small = _stars(large, least)
        done = [path, used, more, last]
        now, path = stored(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "edges"
        )
        remove(spark, done)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
