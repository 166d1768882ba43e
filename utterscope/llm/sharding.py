"""Sharding by longest-processing-time scheduling.

Rows of equal text form a group that stays together. Groups, largest first, go to the least-loaded shard through a heap.
Groups of one size class are interchangeable, so the heap runs over the histogram of size classes: sizes below 2,048 are
classes of their own, larger ones keep 11 leading bits, which bounds the histogram at about 55,000 classes whatever the
data. In the heap, a group counts with the whole part of its class's mean size, which differs from its own by less than a
1,024th; so a shard's load is that of the heap up to a 1,024th of its groups of 2,048 bytes or more, and all is exact with
smaller groups alone. Within a class a group's place in a gapless numbering says which shard takes it.

The text is read once, into a slim table (id, size, checksum, group) in the shared checkpoint folder; only that is
shuffled. Numbers within a class or a shard are made in salted parts, and the join of rows to groups can be split where a
group is hot.

Defined results: a null text has no bytes and is grouped with empty ones; a very long text is one group like any other;
repeated rows are dealt each and stay together; of equal loads the shard of the smaller number is taken; with fewer groups
than shards some shards are empty; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterscope.llm.common import cut, hash_part, table, with_slots

SHARDS = 24
OVERHEAD = 8
CLASS_BITS = 11


def size_class(size: Column) -> Column:
    """The size itself below 2**CLASS_BITS, else with all but its leading CLASS_BITS bits cleared."""
    drop = F.greatest(F.length(F.bin(size)) - CLASS_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def deal(classes: Sequence[tuple[int, int]], shards: int) -> list[list[int]]:
    """Groups of each (size, count) class, largest class first, that each shard takes under the heap's rule.

    Items of size s that follow each other go to the smallest values of load + i * s; all that lie surely below the
    final level are dealt at once, the rest through the heap.
    """
    loads = np.zeros(shards, np.int64)
    counts = []
    for size, n in classes:
        own = np.zeros(shards, np.int64)
        if n > 2 * shards:
            order = np.sort(loads)
            gaps = np.arange(1, shards + 1) * np.append(order[1:], np.inf) - np.cumsum(order)
            k = int(np.searchsorted(gaps, n * size))
            level = (n * size + order[: k + 1].sum()) / (k + 1)
            own = np.maximum(0, np.floor((level - loads) / size).astype(np.int64) - 1)
        heap = [(int(load + m * size), shard) for shard, (load, m) in enumerate(zip(loads, own))]
        heapq.heapify(heap)
        for _ in range(n - int(own.sum())):
            load, shard = heap[0]
            own[shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
        loads = loads + own * size
        counts.append(own.tolist())
    return counts


def shard_rows(slim: DataFrame, group: str = "grp", size: str = "size", shards: int = SHARDS) -> DataFrame:
    """Each row of a slim, materialised table with its shard; rows of a group (a binary hash) have one shard."""
    spark = slim.sparkSession
    groups = cut(slim.groupBy(group).agg(F.sum(size).alias("__size")).withColumn("__class", size_class(F.col("__size"))))
    histogram = groups.groupBy("__class").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("total")).orderBy(F.desc("__class")).collect()
    dealt = deal([(r["total"] // r["n"], r["n"]) for r in histogram], shards)
    plan = spark.createDataFrame(
        [(r["__class"], np.cumsum(own).tolist()) for r, own in zip(histogram, dealt)],
        T.StructType([T.StructField("__class", T.LongType()), T.StructField("__upto", T.ArrayType(T.LongType()))]),
    )
    placed = (
        with_slots(groups, ["__class"], F.substring(F.hex(group), 1, 2), [group], "__rank")
        .join(F.broadcast(plan), "__class")
        .select(group, F.size(F.filter("__upto", lambda upto: upto <= F.col("__rank"))).alias("shard"))
    )
    return slim.join(placed, group)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = cut(
        table(spark, sf_dir, "documents").select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("grp"),  # equal texts have equal hashes; two that collide merely stay together
        )
    )
    placed = cut(shard_rows(slim))
    order = ["doc_id", "text_crc32", "size"]
    slots = with_slots(placed, ["shard"], hash_part(order, 3), order, "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: CRC-32 in SQL, a byte at a time through a table made by its rule: DuckDB has no such function.
_STEP = "list_reduce(list_concat([CAST({0} AS BIGINT)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_BYTES = "list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST(('0x' || h) AS BIGINT))"
_CRC = f"xor(4294967295, list_reduce(list_concat([4294967295], {_BYTES}), lambda c, b: xor(c >> 8, steps[CAST(xor(c & 255, b) + 1 AS INTEGER)])))"

ORACLE_SQL = f"""
WITH RECURSIVE
steps AS (SELECT list(step ORDER BY i) AS steps FROM (SELECT i, {_STEP.format("i")} AS step FROM range(256) x(i))),
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
slim AS MATERIALIZED (SELECT doc_id, CAST(strlen(t) + {OVERHEAD} AS BIGINT) AS size, md5(t) AS grp, {_CRC} AS text_crc32 FROM texts CROSS JOIN steps),
groups AS (SELECT grp, CAST(sum(size) AS BIGINT) AS size FROM slim GROUP BY grp),
classed AS (SELECT grp, size, (size >> greatest(length(bin(size)) - {CLASS_BITS}, 0)) << greatest(length(bin(size)) - {CLASS_BITS}, 0) AS class FROM groups),
classes AS (SELECT class, count(*) AS n, CAST(sum(size) // count(*) AS BIGINT) AS mean FROM classed GROUP BY class),
items AS MATERIALIZED (SELECT row_number() OVER (ORDER BY class DESC) AS i, class, mean FROM (SELECT class, mean, unnest(range(n)) FROM classes)),
heap AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS class, 0 AS place, list_transform(range({SHARDS}), lambda x: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT i, class, place, list_transform(loads, lambda x, k: CASE WHEN k = place THEN x + mean ELSE x END)
  FROM (SELECT items.*, loads, list_position(loads, list_min(loads)) AS place FROM heap JOIN items ON items.i = heap.i + 1)),
taken AS (SELECT class, place - 1 AS shard, row_number() OVER (PARTITION BY class ORDER BY place) AS k FROM heap WHERE i > 0),
placed AS (
  SELECT grp, shard FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY grp) AS k FROM classed) JOIN taken USING (class, k))
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', text_crc32, '|', size)), 1, 3), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM slim JOIN placed USING (grp)
"""
