"""Packing into optimal length buckets.

A dynamic programme over the global length histogram chooses the bucket boundaries that minimise padding; inside each
bucket, batches of a token budget are formed: with every sequence padded to the bucket's boundary, a batch takes
budget // boundary of them (one, if the boundary is above the budget; nothing is cut off).

The histogram has every distinct length; it is the only thing that goes to the driver. The distinct lengths of texts of n
bytes in all are at most sqrt(2 n), as lengths that differ add up: some 14 million over 100 TB, far fewer in practice. The
programme uses that the best boundaries do not move back as the last bucket grows, so a level takes n log n steps, all in
numpy. Places in a bucket are numbered in parts, so no bucket is brought to one task.

Defined results: a null text is empty; a very long text is its bucket's or its batch's only one if need be; repeated rows
are packed each; fewer distinct lengths than buckets give fewer buckets; of equally good boundaries the smaller earlier ones
are taken; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.llm.common import cut, hash_part, table, with_slots

BUCKETS = 8
BUDGET = 1 << 17


def _level(best: np.ndarray, longest: np.ndarray, upto: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each j > least, the smallest i >= least that makes best[i] and the bucket of the lengths i to j - 1 cost least.

    The choices don't fall as j grows: so those of the middles of what is open bound the choices on both sides of them.
    """
    n = len(longest)
    new, choice = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
    low, high = np.array([least + 1]), np.array([n])  # open j
    first, last = np.array([least]), np.array([n - 1])  # their choices
    while len(low):
        middle = (low + high) // 2
        end = np.minimum(last, middle - 1)
        sizes = end - first + 1
        starts = np.cumsum(sizes) - sizes
        i = np.arange(int(sizes.sum())) + np.repeat(first - starts, sizes)
        cost = best[i] + np.repeat(longest[middle - 1], sizes) * (np.repeat(upto[middle], sizes) - upto[i])
        lowest = np.minimum.reduceat(cost, starts)
        hits = np.flatnonzero(cost == np.repeat(lowest, sizes))
        chosen = i[hits[np.searchsorted(hits, starts)]]
        new[middle], choice[middle] = lowest, chosen
        low, high, first, last = (np.concatenate(x) for x in ((low, middle + 1), (middle - 1, high), (first, chosen), (chosen, last)))
        open_ = low <= high
        low, high, first, last = low[open_], high[open_], first[open_], last[open_]
    return new, choice


def boundaries(bins: Sequence[tuple[int, int]] | np.ndarray, buckets: int) -> list[int]:
    """Boundaries (inclusive) for (length, count) in order of length, minimising the padded total.

    best[j] is the least total of the first j lengths in the buckets so far; one more bucket that ends at length j costs it
    times the count of what the bucket takes.
    """
    if not len(bins):
        return []
    longest, counts = np.asarray(bins, np.int64).T
    upto = np.concatenate(([0], np.cumsum(counts)))
    n = len(longest)
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    choices = []
    for level in range(min(buckets, n)):
        best, choice = _level(best, longest, upto, level)
        choices.append(choice.astype(np.int32))
    ends, j = [], n
    for choice in reversed(choices):
        ends.append(int(longest[j - 1]))
        j = int(choice[j])
    return ends[::-1]


def pack(lengths: DataFrame, key: str = "doc_id", length: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """key, length, bucket, bucket_len, n_padding, batch (within the bucket) and slot (within the batch).

    `lengths` is materialised. Places follow a hash of the row, so batches are mixed.
    """
    bins = lengths.groupBy(length).agg(F.count(F.lit(1)).alias("n")).orderBy(length).toArrow()
    ends = boundaries(np.stack([bins[0].to_numpy(), bins[1].to_numpy()], axis=1), buckets) or [1]
    upper = F.array(*[F.lit(e).cast("long") for e in ends])
    bucketed = (
        lengths.select(key, length)
        .withColumn("bucket", F.size(F.filter(upper, lambda e: e < F.col(length))))
        .withColumn("bucket_len", F.get(upper, F.col("bucket")))
    )
    capacity = F.floor(F.greatest(F.lit(budget).cast("long"), F.col("bucket_len")) / F.greatest(F.col("bucket_len"), F.lit(1)))
    placed = with_slots(bucketed, ["bucket"], hash_part([key, length], 3), [key, length], "place").withColumn("capacity", capacity)
    return placed.select(
        key, length, "bucket", "bucket_len", (F.col("bucket_len") - F.col(length)).alias("n_padding"),
        F.floor(F.col("place") / F.col("capacity")).alias("batch"), (F.col("place") % F.col("capacity")).cast("long").alias("slot"),
    )


def byte_lengths(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Lengths of byte-level sequences: UTF-8 bytes and an end mark."""
    return docs.select(key, (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("n_bytes"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(byte_lengths(table(spark, sf_dir, "documents"))), length="n_bytes")


def _levels() -> str:
    """One table for each bucket that the dynamic programme adds."""
    steps = ["best0 AS (SELECT 0 AS j, CAST(0 AS HUGEINT) AS total)"]
    for k in range(1, BUCKETS + 1):
        steps.append(
            f"""best{k} AS (
  SELECT b.j, min(p.total + b.longest * (b.upto - coalesce(q.upto, 0))) AS total,
         arg_min(p.j, (p.total + b.longest * (b.upto - coalesce(q.upto, 0))) * 100000000 + p.j) AS came
  FROM bins b JOIN best{k - 1} p ON p.j < b.j LEFT JOIN bins q ON q.j = p.j GROUP BY b.j)"""
        )
    return ",\n".join(steps)


def _chain() -> str:
    """Walks back from the last bin; with fewer bins than buckets the walk begins at the last level that reaches it."""
    steps = [f"end{BUCKETS} AS (SELECT max(j) AS j, least(max(j), {BUCKETS}) AS levels FROM bins)"]
    for k in range(BUCKETS, 0, -1):
        steps.append(f"end{k - 1} AS (SELECT CASE WHEN e.levels >= {k} THEN b.came ELSE e.j END AS j, e.levels FROM end{k} e LEFT JOIN best{k} b ON b.j = e.j)")
    return ",\n".join(steps)


ORACLE_SQL = f"""
WITH lengths AS MATERIALIZED (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS n_bytes FROM documents),
bins AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY n_bytes) AS INTEGER) AS j, CAST(n_bytes AS HUGEINT) AS longest, sum(count(*)) OVER (ORDER BY n_bytes) AS upto
  FROM lengths GROUP BY n_bytes),
{_levels()},
{_chain()},
ends AS ({" UNION ".join(f"SELECT j FROM end{k}" for k in range(BUCKETS + 1))}),
cuts AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY longest) - 1 AS INTEGER) AS bucket, CAST(longest AS BIGINT) AS bucket_len,
         coalesce(lag(longest) OVER (ORDER BY longest), 0) AS above
  FROM bins WHERE j IN (SELECT j FROM ends)),
placed AS (
  SELECT doc_id, n_bytes, bucket, bucket_len, greatest({BUDGET}, bucket_len) // bucket_len AS capacity,
         row_number() OVER (PARTITION BY bucket ORDER BY substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', n_bytes)), 1, 3), doc_id NULLS FIRST, n_bytes) - 1 AS place
  FROM lengths JOIN cuts ON n_bytes > above AND n_bytes <= bucket_len)
SELECT doc_id, n_bytes, bucket, bucket_len, bucket_len - n_bytes AS n_padding,
       CAST(place // capacity AS BIGINT) AS batch, CAST(place % capacity AS BIGINT) AS slot
FROM placed
"""
