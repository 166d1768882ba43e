"""Vector code compression: product codes whose nearest entries are found through segment-mean lower bounds.

Vectors become integers and are cut into parts; each part has a codebook. For a part x and an entry e, cut into equal
segments, the squared distance is at least the sum over segments of length * (mean x - mean e)^2 + (|rest of x| - |rest of
e|)^2, the rest being what a segment's mean leaves. Whole parts come first, then halves, quarters and eighths: what is above the
exact distance of the best entry so far is dropped, and the survivors of the finest level get exact integer distances. The
bounds are floating-point, so they are lowered by more than their rounding error; no nearest entry, nor a tie, is lost.

A round of training is one scan: tasks add up the parts of each entry, and parts x entries rows of sums come to the driver.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those whose length is zero,
can't be cut into the parts, or differs from the length of the smallest kept id; null ids come after all others; rows that
repeat an id are rows each, and of those at the end of the first entries the smallest vectors are entries; with fewer rows
than entries each row is an entry; equal distances go to the lower index; an empty table gives an empty result; further
columns are not read. Components beyond what an exact 64-bit distance allows (2**28 units at 64 components) are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterscope.llm.common import table, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Segments of a part at each level, coarse to fine; those that don't divide it are left out.
LEVELS = (1, 2, 4, 8)
#: Rows whose bounds are held at once.
STEP = 256
#: Survivors whose distances are taken at once.
PAIRS = 1 << 13
#: Labels up to which their sums are broadcast (some 2 MB); beyond that both sides are shuffled, labels in SALTS pieces.
LABELS = 1 << 16
SALTS = 64


def largest_unit(dim: int) -> int:
    """Components up to this give distances below 2**63."""
    return isqrt((2**63 - 1) // max(dim, 1)) // 2


def _profile(rows: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Points whose squared distances are the bounds (segments' means, weighted, and norms of the rests), their squared norms."""
    cut = rows.reshape(len(rows), segments, -1).astype(np.float64)
    means = cut.mean(axis=2)
    rests = np.sqrt(((cut - means[:, :, None]) ** 2).sum(axis=2))
    points = np.concatenate([means * np.sqrt(cut.shape[2]), rests], axis=1)
    return points, (points * points).sum(axis=1)


class Codebook:
    """The entries of one part."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries

    def __getstate__(self) -> dict:
        return {"entries": self.entries}

    @cached_property
    def levels(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Segments, points and their squared norms of each level."""
        return [(s, *_profile(self.entries, s)) for s in LEVELS if self.entries.shape[1] % s == 0]

    def _exact(self, rows: np.ndarray, at: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Squared distances; 64-bit floats hold them exactly below 2**53 and are faster."""
        most = int(np.abs(rows).max()) + int(np.abs(self.entries).max())
        kind = np.float64 if rows.shape[1] * most * most < 1 << 53 else np.int64
        rows, entries = rows.astype(kind), self.entries.astype(kind)
        out = np.empty(len(at), np.int64)
        for k in range(0, len(at), PAIRS):
            apart = rows.take(at[k : k + PAIRS], axis=0)
            apart -= entries.take(entry[k : k + PAIRS], axis=0)
            out[k : k + PAIRS] = np.einsum("ij,ij->i", apart, apart)
        return out

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and its squared distance."""
        found = [self._nearest(rows[k : k + STEP]) for k in range(0, len(rows), STEP)] or [(np.zeros(0, np.int64),) * 2]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dim, every = rows.shape[1], np.arange(len(rows))
        slack = 1e-11 * dim * float(np.abs(rows).max() + np.abs(self.entries).max() + 1) ** 2
        open_, least = np.ones((len(rows), len(self.entries)), bool), np.full(len(rows), np.iinfo(np.int64).max)
        for segments, points, norms in self.levels:
            own, own_norms = _profile(rows, segments)
            bound = own @ (-2 * points.T)
            bound += norms
            bound += own_norms[:, None]
            np.copyto(bound, np.inf, where=~open_)
            least = np.minimum(least, self._exact(rows, every, bound.argmin(axis=1)))
            open_ = bound <= least[:, None] + slack
        at, entry = np.nonzero(open_)
        exact = self._exact(rows, at, entry)
        least = np.minimum.reduceat(exact, np.searchsorted(at, every))
        best = np.flatnonzero(exact == least[at])  # entries ascend within a row
        return entry[best[np.searchsorted(at[best], every)]], least


def whole_vectors(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that take part, and their components as integers."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = column.filter(pa.array(sizes == dim)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    finite = np.isfinite(flat).all(axis=1)
    with np.errstate(over="ignore"):
        units = np.floor(flat[finite] * scale)
    if len(units) and not np.abs(units).max() <= largest_unit(dim):
        raise ValueError(f"components must be within {largest_unit(dim)} units")
    return rows[finite], units.astype(np.int64)


class Codebooks:
    def __init__(self, dim: int, books: Sequence[np.ndarray], scale: int) -> None:
        self.dim, self.scale, self.books = dim, scale, [Codebook(b) for b in books]

    def assigned(self, units: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of each part, their entries and squared distances."""
        width = self.dim // len(self.books)
        for p, book in enumerate(self.books):
            part = np.ascontiguousarray(units[:, p * width : (p + 1) * width])
            yield part, *book.nearest(part)

    def text(self) -> str:
        return ",".join(str(x) for book in self.books for x in book.entries.ravel().tolist())


def _kept(df: DataFrame, vector: str, parts: int) -> DataFrame:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col(vector)
    return df.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0)).where(F.forall(v, good))


def first_entries(df: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks | None:
    """Codebooks of the smallest ids; at most `entries` vectors come to the driver. None if no row takes part."""
    ordered = _kept(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector")), "vector", parts)
    ordered = ordered.orderBy(F.asc_nulls_last("key"), "vector")
    rows = ordered.limit(entries).collect()
    if not rows:
        return None
    dim = len(rows[0]["vector"])
    if any(len(r["vector"]) != dim for r in rows):
        rows = ordered.where(F.size("vector") == dim).limit(entries).collect()
    units = whole_vectors(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), dim, scale)[1]
    return Codebooks(dim, np.split(units, parts, axis=1), scale)


def _mapped(df: DataFrame, vector: str, keep: Sequence[str], schema: T.StructType, function: Callable) -> DataFrame:
    columns = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keep)]
    return df.select(*columns, F.col(f"`{vector}`").alias("__vector")).mapInArrow(function, schema)


def sums(df: DataFrame, vector: str, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each part and entry that has rows, their number and the sums of their components."""
    width = books.dim // len(books.books)
    names = [f"s{i}" for i in range(width)]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ["n", *names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b.entries), width + 1), np.int64) for b in books.books]
        for batch in batches:
            _, units = whole_vectors(batch.column(0), books.dim, books.scale)
            for p, (part, entry, _) in enumerate(books.assigned(units)):
                order = np.argsort(entry, kind="stable")
                used, starts = np.unique(entry[order], return_index=True)
                if len(used):
                    total[p][used, 1:] += np.add.reduceat(part[order], starts, axis=0)
                    total[p][used, 0] += np.diff([*starts, len(entry)])
        for p, own in enumerate(total):
            used = np.flatnonzero(own[:, 0])
            arrays = [np.full(len(used), p, np.int32), used.astype(np.int32), *own[used].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in arrays], names=schema.names)

    added = _mapped(df, vector, [], schema, run).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *names]])
    return {(r["part"], r["entry"]): (r["n"], [r[c] for c in names]) for r in added.collect()}


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after so many rounds of assigning all rows and moving each used entry to the floor of its rows' mean."""
    books = first_entries(df, key, vector, parts, entries, scale)
    for _ in range(rounds if books else 0):
        moved = [b.entries.copy() for b in books.books]
        for (p, e), (n, total) in sums(df, vector, books).items():
            moved[p][e] = [s // n for s in total]
        books = Codebooks(books.dim, moved, scale)
    return books


def encode(df: DataFrame, books: Codebooks, keep: Sequence[str], vector: str = "embedding") -> DataFrame:
    """`keep`, code (two hexadecimal digits a part) and error (squared distances summed) of each row that takes part."""
    names = [f"__k{i}" for i in range(len(keep))]
    schema = T.StructType([T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keep)] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = whole_vectors(batch.column(batch.num_columns - 1), books.dim, books.scale)
            found = [(entry, error) for _, entry, error in books.assigned(units)]
            digits = np.stack([e for e, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            size = 2 * len(found)
            codes = [digits[k : k + size] for k in range(0, len(digits), size)]
            kept = [batch.column(i).take(pa.array(rows)) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.string()), pa.array(sum(d for _, d in found))], names=schema.names)

    return _mapped(df, vector, keep, schema, run).toDF(*keep, "code", "error")


def label_errors(codes: DataFrame, label: str = "label", bound: int = LABELS) -> DataFrame:
    """The rows with label_error, the errors of all rows of their label; null labels are one label."""
    null_first = [F.col(label).isNull().alias("__null"), F.coalesce(F.col(label), F.lit(0).cast(codes.schema[label].dataType)).alias("__label")]
    total = codes.select(*null_first, "error").groupBy("__null", "__label").agg(F.sum("error").alias("label_error"))
    rows = codes.select("*", *null_first)
    if total.limit(bound + 1).count() <= bound:
        return rows.join(F.broadcast(total), ["__null", "__label"]).drop("__null", "__label")
    salt = F.pmod(F.xxhash64(*codes.columns), F.lit(SALTS)).cast("int")
    spread = total.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(spread, ["__null", "__label", "__salt"]).drop("__null", "__label", "__salt")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = train(vectors)
    if books is None:
        return vectors.where(F.lit(False)).select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")
        )
    codes = written(encode(vectors, books, ["vec_id", "label"]), "codes")
    digest = hashlib.sha256(books.text().encode()).hexdigest()
    return label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _books(n: int) -> str:
    """One round in SQL: assign all parts to the entries of book n - 1, move the entries."""
    return f"""
near{n} AS MATERIALIZED (
  SELECT rid, p, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT x.rid, x.p, b.e, CAST(list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM cut x JOIN book{n - 1} b USING (p)) GROUP BY rid, p),
moved{n} AS (
  SELECT p, e, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS w FROM (
    SELECT p, best.e AS e, i, sum(v) AS s, count(*) AS n
    FROM (SELECT p, best, unnest(w) AS v, unnest(range(len(w))) AS i FROM near{n} JOIN cut USING (rid, p)) GROUP BY p, best.e, i) GROUP BY p, e),
book{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM book{n - 1} b LEFT JOIN moved{n} m USING (p, e)),"""


#: Every round over all rows and entries, without bounds.
ORACLE_SQL = f"""
WITH units AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS u
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT rid, p, u[p * (len(u) // {PARTS}) + 1 : (p + 1) * (len(u) // {PARTS})] AS w FROM units, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, w FROM cut WHERE rid <= {ENTRIES}),
{"".join(_books(n) for n in range(1, ROUNDS + 1))}
{_books(ROUNDS + 1).split("moved")[0]}
coded AS (
  SELECT rid, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{ROUNDS + 1} GROUP BY rid),
digest AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM units JOIN coded USING (rid) CROSS JOIN digest
"""
