"""Exact top-k search with a bit-sliced index.

Each block of vectors is a bit-sliced index: every component, shifted to be non-negative and cut to BITS leading bits, is
kept as BITS bitmaps over the block's rows. For a query, its components (cut to BITS bits as well) weight these slices, and
bitmap full adders sum them into the slices of an approximate score; a negative weight adds the complement. From the most
significant slice of that sum downward, the k-th largest approximate score is found by counting bits. What the cuts left
out is bounded for each query and block, so all rows that can be among the first k are at most twice the bound below;
these boundary rows get their exact integer scores.

Queries and rows meet in a grid: row blocks (by a hash of the row's number) x query blocks. Every query sees every row once,
a cell holds about BLOCK_ROWS rows and BLOCK_QUERIES queries, and gives k rows a query.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part;
vectors of different lengths do not meet; a query's own rows (all rows of its id) are no candidates; each row of a repeated
query id is a query of its own, with k rows of its own; rows that repeat an id are candidates each, in the order of score
and id; fewer candidates than k are all returned; an empty table gives an empty result; further columns are not read.
Components of LARGEST units or more, with which scores might not fit a long, are an error.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from utterscope.llm.common import cut, table

SCALE = 1024
TOP = 10
EVERY = 100
BITS = 8
LARGEST = 1 << 27
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096
QUERY_STEP = 64
EXACT_STEP = 1 << 16

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _bitmap(bits: np.ndarray) -> np.ndarray:
    """Rows of a boolean matrix as bitmaps of 64-bit words."""
    wide = np.zeros((bits.shape[0], -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class BitSlicedIndex:
    """Slices of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, bits: int = BITS):
        self.ids, self.rows, self.bits = ids, rows, bits
        self.low = int(rows.min())
        span = int(rows.max()) - self.low
        self.shift = max(0, span.bit_length() - bits)
        units = (rows - self.low) >> self.shift
        self.slices = np.stack([_bitmap(((units >> b) & 1).astype(bool).T) for b in range(bits)], axis=1)  # component, bit, word
        self.rest = ((1 << self.shift) - 1) / 2
        self.middle = (((1 << bits) - 1) << self.shift) / 2
        kept = units << self.shift
        self.rest_norm = float(np.sqrt((((rows - self.low - kept) - self.rest) ** 2).sum(axis=1).max()))
        self.kept_norm = float(np.sqrt(((kept - self.middle) ** 2).sum(axis=1).max()))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in query_ids, ids and scores of each query's first k rows of other ids."""
        found = [self._search(query_ids[at : at + QUERY_STEP], queries[at : at + QUERY_STEP], k, at) for at in range(0, len(queries), QUERY_STEP)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _sum(self, weights: np.ndarray, negative: np.ndarray) -> np.ndarray:
        """Slices (bit, query, word) of the sum of weight * component, of its complement where negative."""
        top = (int(weights.sum(axis=1).max()) * ((1 << self.bits) - 1)).bit_length() + 1
        words = self.slices.shape[2]
        total = np.zeros((top, len(weights), words), np.uint64)
        flip = np.where(negative, _ALL, np.uint64(0))
        for d in range(weights.shape[1]):
            own = [self.slices[d, b][None, :] ^ flip[:, d, None] for b in range(self.bits)]
            for j in range(int(weights[:, d].max()).bit_length()):
                on = (np.uint64(0) - ((weights[:, d] >> j) & 1).astype(np.uint64))[:, None]
                carry = np.zeros((len(weights), words), np.uint64)
                for b in range(self.bits):
                    add = own[b] & on
                    at = total[j + b]
                    half = at ^ add
                    carry_out = (at & add) | (half & carry)
                    np.bitwise_xor(half, carry, out=at)
                    carry = carry_out
                for p in range(j + self.bits, top):
                    if not carry.any():
                        break
                    at = total[p]
                    carry_out = at & carry
                    np.bitwise_xor(at, carry, out=at)
                    carry = carry_out
        return total

    def _search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.abs(queries)
        cut_bits = max(0, int(size.max()).bit_length() - self.bits)
        weights, sign = size >> cut_bits, np.where(queries < 0, -1, 1)
        total = self._sum(weights, queries < 0)
        lost = sign * (size - (weights << cut_bits))
        bound = np.sqrt((queries.astype(float) ** 2).sum(axis=1)) * self.rest_norm + np.sqrt((lost.astype(float) ** 2).sum(axis=1)) * self.kept_norm
        unit = float(1 << (cut_bits + self.shift))
        margin = np.ceil(2 * bound * (1 + 1e-9) / unit).astype(np.int64) + 1
        others = _bitmap(self.ids[None, :] != query_ids[:, None])
        least = np.maximum(0, self._kth(total, k, others) - margin)
        rows = self._at_least(total, least, others)
        at = np.flatnonzero(np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")[:, : len(self.rows)].ravel())
        q, r = at // len(self.rows), at % len(self.rows)
        score = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", queries[q[i : i + EXACT_STEP]], self.rows[r[i : i + EXACT_STEP]]) for i in range(0, len(q), EXACT_STEP))])
        order = np.lexsort((self.ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        return q[keep] + base, self.ids[r[keep]], score[keep]

    def _kth(self, total: np.ndarray, k: int, rows: np.ndarray) -> np.ndarray:
        """The k-th largest sum of each query among its rows (bitmaps), 0 if there are fewer."""
        open_ = rows
        above = np.zeros(total.shape[1], np.int64)
        value = np.zeros(total.shape[1], np.int64)
        for p in range(total.shape[0] - 1, -1, -1):
            ones = open_ & total[p]
            count = np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
            enough = above + count >= k
            value[enough] |= 1 << p
            above[~enough] += count[~enough]
            open_ = np.where(enough[:, None], ones, open_ & ~total[p])
        return value

    def _at_least(self, total: np.ndarray, least: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Bitmaps of those of each query's rows whose sum is `least` or more."""
        equal = rows.copy()
        more = np.zeros_like(equal)
        for p in range(total.shape[0] - 1, -1, -1):
            on = (np.uint64(0) - ((least >> p) & 1).astype(np.uint64))[:, None]
            more |= equal & total[p] & ~on
            equal &= ~(total[p] ^ on)
        return more | equal


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _cell(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    if not rows.num_rows or not queries.num_rows:
        empty = pa.array([], pa.int64())
        return pa.table({"query": empty, "query_id": empty, "vec_id": empty, "score": empty})
    index = BitSlicedIndex(rows["id"].to_numpy(), _matrix(rows["v"]))
    query_ids = queries["id"].to_numpy()
    at, ids, scores = index.search(query_ids, _matrix(queries["v"]), k)
    return pa.table({"query": queries["n"].to_numpy()[at], "query_id": query_ids[at], "vec_id": ids, "score": scores})


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows of highest integer inner product with each query row."""
    whole = F.col("v").isNotNull() & (F.size("v") > 0)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    too_large = F.raise_error(F.lit(f"components must be within {LARGEST} units")).cast("long")
    slim = cut(
        vectors.where(F.col(key).isNotNull())
        .select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
        .where(whole).where(finite)
        .withColumn("v", F.transform("v", lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale)).otherwise(too_large)))
        .withColumn("d", F.size("v"))
        .withColumn("n", F.monotonically_increasing_id())
    )
    counts = slim.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    row_blocks, query_blocks = max(1, -(-counts[0] // BLOCK_ROWS)), max(1, -(-counts[1] // BLOCK_QUERIES))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        """Each row with its block, once for every block of the other side."""
        each = F.explode(F.sequence(F.lit(0), F.lit(others - 1)).cast("array<long>"))
        return df.withColumn(own, F.pmod(F.xxhash64("n"), F.lit(blocks))).withColumn(other, each).select("d", "rb", "qb", "n", "id", "v")

    rows = dealt(slim, "rb", row_blocks, "qb", query_blocks)
    queries = dealt(slim.where("is_query"), "qb", query_blocks, "rb", row_blocks)
    cells = rows.groupBy("d", "rb", "qb").cogroup(queries.groupBy("d", "rb", "qb"))
    near = cells.applyInArrow(partial(_cell, k=k), "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = f"""
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, embedding, len(embedding) AS d FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
flat AS MATERIALIZED (
  SELECT r, vec_id, d, unnest(generate_series(1, d)) AS i, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM whole),
scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, e.r, e.vec_id, CAST(sum(q.x * e.x) AS BIGINT) AS score
  FROM flat q JOIN flat e ON q.i = e.i AND q.d = e.d AND q.vec_id <> e.vec_id
  WHERE q.vec_id % {EVERY} = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""
