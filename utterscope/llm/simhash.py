"""SimHash near-duplicates through a Gray-order hierarchical index.

Each text has a 64-bit fingerprint of its word shingles. Distinct fingerprints are dealt to buckets by every choice of
`c` of `d + c` bit blocks: two fingerprints that differ in at most d bits agree in c blocks at least, so they share a
bucket. `c` grows with the number of fingerprints, so that buckets stay small. In a bucket, fingerprints are sorted by
Gray rank and grouped into a hierarchy; an upper node keeps the bits that its fingerprints share (mask and pattern). Pairs
of nodes are descended together: the differences in commonly masked bits only add up on the way down, so a pair of groups
whose differences exceed d is pruned whole. A bucket gives a spanning forest of its links, not all pairs.

Buckets of more than `TILE` fingerprints are split into salted parts, and each pair of parts is a bucket of its own, so no
link is lost and none is too large for a task. Components come from checkpointed star steps on the links.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other; texts of fewer words than
a shingle are one shingle; very long texts are hashed whole; repeated rows have one fingerprint and so one component; rows with a null id take part only
through others of their fingerprint (component null if there are none); an empty table gives an empty result; further
columns are not read by the fingerprints and are kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterscope.llm.common import cut, map_texts, maybe_among, table
from utterscope.llm.components import components
from utterscope.llm.similar import bands, digest, shingle_set, similar_duplicates

SHINGLE = 4
DISTANCE = 4
SEED = 42
FAN = 8
TILE = 20_000
PAIR_STEP = 1 << 13
BIT_STEP = 1 << 16
#: Comparisons that shuffling a row is worth.
ROW_COST = 1000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Big-endian XXH64 hashes of the word shingles, A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, ">u8")
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[shingle:] or starts[-1:]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[s : e - 1], SEED) for s, e in zip(starts, ends)]), ">u8")


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the big-endian hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BIT_STEP):
        counts += np.unpackbits(hashes[at : at + BIT_STEP].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles."""
    hashes = shingle_hashes(text, shingle)
    return _majority(hashes) if len(hashes) else 0


def _columns(texts: Sequence[str | None], shingle: int) -> dict[str, list]:
    return {"fp": [fingerprint(t, shingle) for t in texts]}


def sketches(texts: Sequence[str | None], shingle: int) -> dict[str, list]:
    """The fingerprint, the shingle set's digest and its MinHash bands."""
    out: dict[str, list] = {"fp": [], "sig": [], "bands": []}
    for text in texts:
        hashes = shingle_hashes(text, shingle)
        own = shingle_set(hashes)
        for name, got in zip(out, (_majority(hashes) if len(hashes) else 0, digest(own), bands(own))):
            out[name].append(got)
    return out


def bit_masks(count: int, distance: int) -> list[int]:
    """Signed masks of the tables for `count` fingerprints: each keeps c of distance + c blocks.

    c makes the cost of a fingerprint least: each table costs ROW_COST to shuffle and half a bucket of comparisons.
    """

    def cost(c: int) -> float:
        return comb(distance + c, c) * (ROW_COST + count / 2 ** (64 * c // (distance + c)) / 2)

    c = min(range(1, 7), key=cost)
    blocks = distance + c
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in range(blocks)]
    masks = [sum(block[k] for k in own) for own in combinations(range(blocks), c)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def gray_rank(fp: np.ndarray) -> np.ndarray:
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Level:
    """Nodes of one level: the bits that are set in all and in any of their fingerprints, and their children."""

    def __init__(self, every: np.ndarray, some: np.ndarray, first: np.ndarray | None):
        self.pattern, self.mask, self.first = every, ~(every ^ some), first


def _hierarchy(bucket: np.ndarray, fp: np.ndarray) -> list[_Level]:
    """Levels from the fingerprints up to one node a bucket; both arrays are sorted by bucket and Gray rank."""
    levels = [_Level(fp, fp, None)]
    every = some = fp
    while True:
        new = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]) != 0)
        if len(new) == len(bucket):
            return levels
        sizes = np.diff(np.append(new, len(bucket)))
        place = np.arange(len(bucket)) - np.repeat(new, sizes)
        starts = np.flatnonzero(place % FAN == 0)
        every, some = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts)
        bucket = bucket[starts]
        levels.append(_Level(every, some, np.append(starts, len(place))))


def _children(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs, each unordered pair once."""
    na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
    each = na * nb
    pair = np.repeat(np.arange(len(a)), each)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
    i, j = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
    keep = (a[pair] != b[pair]) | (i <= j)
    return i[keep], j[keep]


def forest(bucket: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint (sorted by bucket, Gray rank) the first one of its bucket that links reach."""
    levels = _hierarchy(bucket, fp)
    root = np.arange(len(fp))
    if len(levels) == 1:
        return root
    first = levels[1].first
    members = np.minimum(first[:-1, None] + np.arange(FAN), first[1:, None] - 1)  # a short group repeats its last one
    tops = np.arange(len(levels[-1].pattern))
    stack = [(len(levels) - 1, tops, tops)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIR_STEP:
            stack += [(level, a[PAIR_STEP:], b[PAIR_STEP:]), (level, a[:PAIR_STEP], b[:PAIR_STEP])]
            continue
        if level == 1:
            left, right = members[a], members[b]
            near = np.bitwise_count(fp[left][:, :, None] ^ fp[right][:, None, :]) <= distance
            pair, i, j = np.nonzero(near)
            i, j = left[pair, i], right[pair, j]
            _join(root, i[i != j], j[i != j])
            continue
        i, j = _children(levels[level].first, a, b)
        below = levels[level - 1]
        near = np.bitwise_count((below.pattern[i] ^ below.pattern[j]) & below.mask[i] & below.mask[j]) <= distance
        if near.any():
            stack.append((level - 1, i[near], j[near]))
    return root


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hook the larger root of each pair to the smaller one until all pairs have one root each."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the buckets of one partition that is sorted by bucket; the last bucket waits for its rest."""

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        same = rows[0][1:] == rows[0][:-1]
        rows = rows[:, np.append(same, False) | np.append(False, same)]
        rows = rows[:, np.lexsort((gray_rank(rows[2].view(np.uint64)), rows[0]))]
        bucket, node, fp = rows[0], rows[1], rows[2].view(np.uint64)
        root = forest(bucket, fp, distance) if len(fp) else np.zeros(0, np.int64)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["u", "v"])

    held = None
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)])
        if not rows.shape[1]:
            continue
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        cut_at = int(np.searchsorted(rows[0], rows[0][-1]))
        held = rows[:, cut_at:]
        if cut_at:
            yield solve(rows[:, :cut_at])
    if held is not None:
        yield solve(held)


def links(fps: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect the same nodes as all pairs of fingerprints at most `distance` bits apart do.

    `fps` is materialised and has distinct long fingerprints `fp` with their ids `node`.
    """
    count = fps.count()
    masks = bit_masks(count, distance)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    rows = fps.select("node", F.col("fp").alias("near"), F.explode(tables).alias("k")).select(F.xxhash64("k.t", "k.key").alias("bucket"), "node", "near")
    columns = rows.columns
    large = cut(rows.groupBy("bucket").count().where(F.col("count") > tile))
    if large.count():
        parts = F.ceil(F.col("count") * 2 / tile).cast("int")
        split = (
            rows.join(large.select("bucket", parts.alias("parts")), "bucket", "left")
            .withColumn("part", F.pmod(F.xxhash64("near"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        )
        tiles = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
        rows = split.withColumn("bucket", F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(tiles)).select(columns)
    partitions = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), count * len(masks) // 4_000_000)
    dealt = rows.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(partial(_links, distance=distance), "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """key, fp (signed long) and component_id (smallest key that links reach) of every row."""
    prints = cut(map_texts(docs, text, partial(_columns, shingle=shingle), [T.StructField("fp", T.LongType())], [key]))
    fps = cut(prints.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("node")))
    found = components(links(fps, distance))
    labelled = cut(fps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return prints.join(labelled, "fp", "left").select(key, "fp", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE, similar: float | None = None) -> DataFrame:
    """One row of each component: that of its smallest key (of rows that repeat this key, one). Rows with a null key stay.

    With `similar`, fingerprints only give candidates, and links are shingle similarities of at least that.
    """
    if similar is not None:
        found = similar_duplicates(docs, text, key, shingle, distance, similar)
    else:
        found = near_duplicates(docs.where(F.col(key).isNotNull()), text, key, shingle, distance)
    kept = F.coalesce(F.col(key) == F.col("component_id"), F.lit(False))
    ids = cut(found.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__rows"), F.max(kept).alias("__kept")))
    rows = maybe_among(docs.where(F.col(key).isNotNull()), key, ids.where("__rows > 1 or not __kept").select("__key"))
    others = rows.where("not __maybe").drop("__maybe")  # of kept ids that one row has: they stay where they are
    ids = ids.where("__kept").select("__key")
    once = rows.where("__maybe").drop("__maybe").join(ids, F.col(key) == F.col("__key"), "left_semi").dropDuplicates([key])
    return others.unionByName(once).unionByName(docs.where(F.col(key).isNull()))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
