"""Near-duplicates by exact shingle similarity, over candidates of SimHash and MinHash.

Texts are linked if the sets of their shingles' hashes have a Jaccard similarity of at least `least`. Candidates are the
links of SimHash fingerprints, and, as texts of similarity 0.8 differ in some 10 of 64 bits, too many for an index alone,
texts that agree in all ROWS least hashes of one of BANDS bands (a pair of similarity 0.8 meets in one with probability
1 - (1 - 0.8 ** ROWS) ** BANDS, over 0.999). They only decide which texts are compared: the sets of each candidate component
come together, and its texts are linked anew by their exact similarity, pairs that were no candidates among them, so no
connection hangs on which candidate links a forest kept.

A candidate component of over TILE texts is dealt to parts. Texts are linked within each part, then the smallest texts of
what is linked; if that leaves a component apart, the texts outside its largest group are compared with all its texts,
part by part. What is skipped is only pairs that are connected already. Within a task, sets of similarity `least` share one
of their first n - ceil(least * n) + 1 hashes, so only those are looked up.

Defined results: texts without words are alike, and like no other; texts of fewer words than a shingle are one shingle;
rows that repeat an id are one node; rows with a null id have no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterscope.llm.arrays import mixed
from utterscope.llm.common import cut, map_texts, maybe_among
from utterscope.llm.components import components

BANDS = 20
ROWS = 5
STEP = 1 << 12
TILE = 256

_TIMES = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = np.random.default_rng(43).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(hashes.astype(np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """Signed keys of the bands of a shingle set."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), STEP):
        np.minimum(least, (own[at : at + STEP] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(3) + column)
    return keys.view(np.int64)


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _sets(texts: Sequence[str | None], shingle: int, hashes) -> dict[str, list]:
    found = [shingle_set(hashes(t, shingle)) for t in texts]
    return {"sig": [digest(s) for s in found], "own": [s.tobytes() for s in found]}


def roots(sets: Sequence[np.ndarray], labels: Sequence[int], least: float) -> np.ndarray:
    """For each set, the first one that similarities of at least `least`, and equal labels, connect it to."""
    root = np.arange(len(sets))
    at_label: dict[int, int] = {}
    for i, label in enumerate(labels):
        root[i] = at_label.setdefault(label, i)
    at_token: dict[int, list[int]] = {}
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        own = sets[i]
        n = len(own)
        if not n:
            continue
        first = own[: n - ceil(least * n - 1e-9) + 1].tolist()
        near = [at_token[t] for t in first if t in at_token]
        todo = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
        while len(todo := todo[root[todo] != root[i]]):
            j, todo = int(todo[0]), todo[1:]
            other = sets[j]
            if len(other) < least * n - 1e-9:
                continue
            both = len(np.intersect1d(own, other, assume_unique=True))
            if both >= least * (n + len(other) - both) - 1e-9:
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
        for t in first:
            at_token.setdefault(t, []).append(i)
    return root


def _confirmed(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Spanning links of each bucket of one partition that is sorted by bucket."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        once = list({(node, own): (node, label, own) for _, node, label, own in rows}.values())
        root = roots([np.frombuffer(own, np.uint64) for _, _, own in once], [label for _, label, _ in once], least).tolist()
        links = [(once[i][0], once[r][0]) for i, r in enumerate(root) if i != r]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _linked(rows: DataFrame, least: float) -> DataFrame:
    """Links (u, v) of rows (bucket, node, label, own) within their buckets."""
    dealt = rows.select("bucket", "node", "label", "own").repartition("bucket").sortWithinPartitions("bucket")
    return cut(dealt.mapInArrow(partial(_confirmed, least=least), "u long, v long"))


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    found = cut(components(links)).withColumnRenamed("component", "label")
    return rows.drop("label").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))


def confirmed_links(rows: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """Links that connect what similarities of at least `least` connect within each component.

    `rows` is materialised and has a candidate `component`, a `node` and its shingle set `own`.
    """
    sizes = cut(rows.groupBy("component").count().where(F.col("count") > tile))
    part = lambda n: F.ceil(F.col(n) / F.lit(tile)).cast("int")
    dealt = (
        rows.join(F.broadcast(sizes), "component", "left")  # a row for `tile` candidates at most, so that sets stay in place
        .withColumn("parts", F.coalesce(part("count"), F.lit(1))).withColumn("label", F.col("node"))
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("bucket", F.xxhash64("component", "part"))
    )
    links = _linked(dealt, least)
    large = dealt.where("parts > 1")
    if not sizes.count():
        return links
    tops = cut(_labelled(large, links).where("node = label"))
    groups = tops.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    among = tops.join(cut(groups), "component").withColumn("bucket", F.xxhash64("component", F.pmod(F.xxhash64("node", F.lit(1)), part("n"))))
    links = links.unionAll(_linked(among, least))
    now = cut(_labelled(large, links))
    counts = cut(now.groupBy("component", "label").count())
    largest = counts.groupBy("component").agg(F.max_by("label", F.struct("count", "label")).alias("largest"), F.sum("count").alias("all"), F.max("count").alias("most"))
    apart = cut(largest.where(F.col("all") > F.col("most")).withColumn("chunks", F.ceil((F.col("all") - F.col("most")) / F.lit(tile)).cast("int")))
    open_ = cut(now.select("component", "node", "label", "own", "parts", "part").join(apart.select("component", "largest", "chunks"), "component"))
    every = open_.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rest = (
        open_.where("label <> largest").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    tiles = every.unionByName(rest).withColumn("bucket", F.xxhash64("component", "part", "chunk"))
    return links.unionAll(_linked(tiles, least))


def similar_duplicates(docs: DataFrame, text: str, key: str, shingle: int, distance: int, least: float) -> DataFrame:
    """key and component_id (smallest key that links reach) of every row with a key."""
    from utterscope.llm.simhash import links, shingle_hashes, sketches

    slim = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("node"), F.col(text).alias("text"))
    fields = [T.StructField("fp", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    prints = cut(map_texts(slim, "text", partial(sketches, shingle=shingle), fields, ["node"]))
    nodes = cut(prints.groupBy("sig").agg(F.min("node").alias("first"), *[F.min_by(c, "node").alias(c) for c in ("fp", "bands")]).withColumnRenamed("first", "node"))
    dealt = nodes.select("node", F.explode("bands").alias("band"))
    meets = cut(dealt.groupBy("band").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    stars = dealt.join(meets, "band").where("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    candidates = cut(components(links(nodes.select("node", "fp"), distance).unionAll(stars)))
    fields = [T.StructField("sig", T.BinaryType()), T.StructField("own", T.BinaryType())]
    maybe = maybe_among(slim, "node", candidates.select("node")).where("__maybe")
    sets = map_texts(maybe, "text", partial(_sets, shingle=shingle, hashes=shingle_hashes), fields, ["node"])
    once = cut(sets.join(candidates, "node").groupBy("component", "node", "sig").agg(F.first("own").alias("own")))
    found = components(confirmed_links(once, least))
    labelled = cut(nodes.select("sig", "node").join(found, "node", "left").select("sig", F.coalesce("component", "node").alias("component_id")))
    return prints.select("sig", F.col("node").alias(key)).join(labelled, "sig").select(key, "component_id")
