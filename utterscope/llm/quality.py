"""Quality classifier: supervised subword embeddings.

Hashed vectors of words, of character n-grams and of "this word repeats one of the last three" are learned by stochastic
gradient descent in numpy, averaged per document within each of these three fields, and put through a softmax layer. As
the output is linear in the averaged vectors, scoring folds each vector and the output layer into one number per bucket.

The fit uses a bounded sample: at most `max_labels` labelled rows in the order of a hash of their id, of texts up to
`max_chars`. Every document is scored over its whole text.

Defined results: a null or empty text gets the score of the learned bias; very long texts are scored whole; null ids are not held out; labels that are null
are not learned, of several labels of one id the smallest counts, and of several texts the first; without any label every score is 0.5; repeated rows
are scored each; an empty table gives an empty result; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterscope.llm.arrays import run_hashes, runs, sums_between
from utterscope.llm.common import map_texts, safe_names, small_batches, table

BITS = 17
DIM = 8
GRAMS = (3, 4)
LAGS = (1, 2, 3)
#: Buckets: hashed words, hashed n-grams, and 1 + len(LAGS) for repetition.
WORDS, CHARS = 0, 1 << BITS
REPEATS = 2 << BITS
BUCKETS = REPEATS + 1 + len(LAGS)
FIELDS = 3
CHUNK_CHARS = 1 << 18


def _field_features(points: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(position, bucket) of each feature, by field, of code points whose white space is 32; no feature spans two texts."""
    word = points != 32
    starts, ends = runs(word)
    hashes = run_hashes(points, starts, ends)
    words = WORDS + (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    again = np.zeros(len(hashes), np.int64)
    text = np.searchsorted(bounds, starts, side="right")
    for lag in reversed(LAGS):
        again[lag:][(hashes[lag:] == hashes[:-lag]) & (text[lag:] == text[:-lag])] = lag
    at, grams = [], []
    wide = points.astype(np.uint32)
    for n in GRAMS:
        count = len(points) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, np.uint32)
        inner = np.ones(count, bool)
        for k in range(n):
            h = h * np.uint32(0x01000193) + wide[k : k + count] * np.uint32(0x9E3779B1)
            if 0 < k < n - 1:
                inner &= word[k : k + count]
        where = np.flatnonzero(inner)
        h = h[where]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        at.append(where)
        grams.append(CHARS + (h >> np.uint32(32 - BITS)).astype(np.int64))
    return [(starts, words), *zip(at, grams), (starts, REPEATS + again)]


#: The field of each group of features above.
FIELD_OF = (0, *(1 for _ in GRAMS), 2)


def _points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each within a pair of blanks, and where each text begins and the last ends."""
    padded = [f" {t or ''} " for t in texts]
    bounds = np.zeros(len(padded) + 1, np.int64)
    np.cumsum([len(t) for t in padded], out=bounds[1:])
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[points < 33] = 32
    return points, bounds


def _doc_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and the weight of each in the averaged vectors."""
    groups = _field_features(*_points([text]))
    buckets, weights = [], []
    for field in range(FIELDS):
        own = [b for (_, b), f in zip(groups, FIELD_OF) if f == field and len(b)]
        if own:
            found, counts = np.unique(np.concatenate(own), return_counts=True)
            buckets.append(found.astype(np.int32))
            weights.append((counts / counts.sum()).astype(np.float32))
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(buckets), np.concatenate(weights)


@dataclass(frozen=True)
class Classifier:
    """One number per bucket and a bias: the difference of the two softmax inputs."""

    weight: np.ndarray
    bias: float

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probability of label 1 of each whole text."""
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK_CHARS):
                size += len(texts[end] or "")
                end += 1
            out[at:end] = self._logits(texts[at:end])
            at = end
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

    def _logits(self, texts: Sequence[str | None]) -> np.ndarray:
        points, bounds = _points(texts)
        sums, counts = np.zeros((FIELDS, len(texts))), np.zeros((FIELDS, len(texts)))
        for (position, bucket), field in zip(_field_features(points, bounds), FIELD_OF):
            cuts = np.searchsorted(position, bounds)
            sums[field] += sums_between(self.weight[bucket], cuts)
            counts[field] += np.diff(cuts)
        return self.bias + (sums / np.maximum(counts, 1)).sum(axis=0)


def fit(texts: Sequence[str], labels: Sequence[int], epochs: int = 6, rate: float = 0.5, seed: int = 1) -> Classifier:
    """Stochastic gradient descent, one document a step, with per-row adaptive rates."""
    if not len(texts):
        return Classifier(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    seen = np.full(BUCKETS, 1e-6, np.float32)
    output, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    output[:, 1] = rng.uniform(-1, 1, DIM)
    output_seen = np.float32(1e-2)
    docs = [_doc_features(t) for t in texts]
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in rng.permutation(len(docs)):
            buckets, w = docs[i]
            own = vectors[buckets]
            hidden = w @ own
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = output @ p
            output_seen += float(p @ p) * float(hidden @ hidden)
            output -= step / np.sqrt(output_seen) * np.outer(hidden, p)
            bias -= np.float32(0.02) * p
            if len(buckets):
                seen[buckets] += w * w * (back @ back)
                vectors[buckets] = own - (step * np.float32(0.3) * w / np.sqrt(seen[buckets]))[:, None] * back
    fold = output[:, 1] - output[:, 0]
    return Classifier((vectors @ fold).astype(np.float32), float(bias[1] - bias[0]))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit_on_labels(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", held_out: int = 2, max_labels: int = 6000, max_chars: int = 30_000) -> Classifier:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    The ids are chosen from the labels alone (at most max_labels of them, so they can be broadcast); the chosen texts, at
    most max_labels * max_chars characters, meet in one task, and only the weights come to the driver.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold_of(F.col(key)) != held_out))
        .groupBy(F.col(key).alias("__key")).agg(F.min(label).cast("int").alias("__label"))
        .where(F.col("__label").isin(0, 1))
        .orderBy(F.xxhash64("__key"), "__key").limit(max_labels)
    )
    rows = (
        docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
        .where(F.char_length("__text") <= max_chars)
        .join(F.broadcast(chosen), "__key")
        .groupBy("__key", "__label").agg(F.min("__text").alias("__text"))  # one row an id, however often it repeats
    )
    small_batches(docs.sparkSession)
    fitted = rows.repartition(1).sortWithinPartitions("__key").select("__text", "__label").mapInArrow(_fitted, "weight binary, bias double").first()
    if fitted is None:  # no labelled text: no task
        return fit([], [])
    return Classifier(np.frombuffer(bytes(fitted["weight"]), np.float32), fitted["bias"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts: list[str] = []
    labels: list[int] = []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
    model = fit(texts, labels)
    yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], names=["weight", "bias"])


def _scored(texts: Sequence[str | None], model) -> dict[str, np.ndarray]:
    return {"score": model.value.score(texts)}


def score_quality(docs: DataFrame, model: Classifier, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` and the score of each whole text. The broadcast model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text, partial(_scored, model=shared), [T.StructField("score", T.DoubleType())], keep)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows whose text scores at least `threshold`, with their columns unchanged."""
    model = fit_on_labels(docs, labels, text, key)
    plain, names = safe_names(docs)
    scored = score_quality(plain, model, names[text], list(names.values()))
    return scored.where(F.col("score") >= threshold).select(*[F.col(n).alias(c) for c, n in names.items()])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
