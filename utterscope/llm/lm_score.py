"""LM scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the background corpus, share one vocabulary: every word of both. They have
the same order and smoothing. A document's score is the mean over its tokens (words, A-Z lower-cased and split at ASCII
white space, and the end mark) of the target model's loss minus the background model's: the lower, the more the document
is like the target.

P(w | v) = (n(v w) + alpha * P(w)) / (n(v) + alpha), P(w) = (n(w) + 1) / (N + outcomes), where the outcomes are the words
of both corpora, the end mark and an unknown word.

The counts are sparse and grow with the input; none is broadcast or brought to the driver. Documents are dealt to blocks
of about BLOCK_BYTES and stored, a block a row, so that whoever reads them again, however files are split, has the same blocks.
With the parts blocks grow (up to MOST_BLOCK_BYTES), so that a block has LEAST_ENTRIES or more for a part and rows grow as the
text does. A block's distinct words and bigrams go, as sorted hashes with their counts, to the parts of the hash
space; a part sums the counts of all blocks and answers each block with the counts of the hashes that it asked about, in
the same order; a block then scores its own texts. So what is shuffled is a block's distinct bigrams, however hot one is,
and a part holds about PART_ENTRIES of them whatever the input. Words and bigrams are told apart by 64-bit hashes.

Defined results: null texts are empty and have the end mark only; a text longer than a block is a block of its own; repeated
rows are counted and scored each, and so equally; with an empty target all words are equally likely under its model; an
empty background table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterscope.llm.arrays import mixed, run_hashes, runs
from utterscope.llm.common import small_batches, table, written

ALPHA = 20.0
BLOCK_BYTES = 4 << 20
MOST_BLOCK_BYTES = 32 << 20
LEAST_ENTRIES = 64
PART_ENTRIES = 1 << 21
PART_BITS = 8
#: Bytes of text that are hashed at once: a step's arrays are many times its text.
HASH_BYTES = 128 << 10
#: How blocks, which are compressed, are stored: sizes are looked at after each row, not after 100, as pages and groups of rows
#: are held in memory whole. And how answers are stored.
STORED: dict[str, int | str] = {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size": 8 << 20, "compression": "none"}
ANSWERS: dict[str, int | str] = {"compression": "zstd"}
ANSWER_ENTRIES = 1 << 19
#: White space that parts words, and capital letters. Fixed values.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK = np.uint64(0x5851F42D4C957F2D)
WORDS, PAIRS = 0, 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], made over about HASH_BYTES at a time."""
    cuts = np.searchsorted(starts, np.arange(0, len(data) + HASH_BYTES, HASH_BYTES)).tolist()
    return np.concatenate([
        run_hashes(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]) for a, b in zip(cuts, cuts[1:]) if a < b
    ] or [np.zeros(0, np.uint64)])


def _words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, text after text, and where each text's begin (and the last one's end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    lines = np.cumsum([len(x) + 1 for x in raw])
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    del raw
    starts, ends = runs(~_SPACE[data])
    hashes = _hashes(data, starts, ends)
    marks = np.searchsorted(starts, lines) + np.arange(len(lines))  # after the words of the texts so far
    words = np.full(len(hashes) + len(lines), _MARK)
    at = np.ones(len(words), bool)
    at[marks] = False
    words[at] = hashes
    return words, np.concatenate(([0], marks + 1))


def _keys(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens and of all bigrams, text after text, and where each text's begin (and the last one's end).

    A token's bigram is it and what stands before it, a mark for the first word; the last token is the end mark.
    """
    words, bounds = _words(texts)
    pairs = np.concatenate(([_MARK], words))[:-1]
    pairs *= np.uint64(3)
    pairs += words
    return words, mixed(pairs), bounds


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as a count of planes and planes of equal bytes, the low ones first, without those that are all zero."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _length(planes: bytes) -> int:
    return (len(planes) - 1) // planes[0]


def _numbers(planes: bytes) -> np.ndarray:
    made = np.zeros((_length(planes), 8), np.uint8)
    made[:, : planes[0]] = np.frombuffer(planes, np.uint8, offset=1).reshape(planes[0], -1).T
    return made.view("<u8").ravel()


def _parted(own: np.ndarray, bits: int) -> np.ndarray:
    """Where each part of the hash space begins in sorted hashes, and where the last one ends."""
    cuts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(own, cuts), [len(own)]))


_ENTRY = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _entries(blocks: Iterator[tuple[int | None, list[str | None]]], bits: int) -> Iterator[pa.RecordBatch]:
    """For each part that a block has hashes in: the hashes (differences) and their counts. A target has no block."""
    for block, texts in blocks:
        words, pairs, _ = _keys(texts)
        rows: list[tuple] = []
        for kind, keys in ((WORDS, words), (PAIRS, pairs)):
            own, counts = np.unique(keys, return_counts=True)
            cuts = _parted(own, bits).tolist()
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    steps = np.diff(own[a:b], prepend=np.uint64(0))
                    rows.append((part * 2 + kind, block, _planes(steps), _planes(counts[a:b])))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY)], schema=_ENTRY)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """A row for each run of about `limit` bytes of the last column, the text: a number that no other has, and the rows."""
    from pyspark import TaskContext

    block, size = TaskContext.get().partitionId() << 32, 0
    held: list[pa.Array] = []

    def made() -> pa.RecordBatch:
        rows = pa.concat_arrays(held)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays([0, len(rows)], rows)], names=["block", "rows"])

    for batch in batches:
        rows, first = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names), 0
        for i, length in enumerate(pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()):
            length = (length or 0) + 1
            if size and size + length > limit:
                if i > first:
                    held.append(rows[first:i])
                yield made()
                block, size, held, first = block + 1, 0, [], i
            size += length
        if first < len(rows):
            held.append(rows[first:])
    if held:
        yield made()


def _packed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The blocks, the rows of each compressed: they are stored, shuffled and twice sent to Python."""
    options = pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)
    for made in _blocks(batches, limit):
        rows = pa.RecordBatch.from_struct_array(made.column("rows").values)
        with pa.BufferOutputStream() as to:
            with pa.ipc.new_stream(to, rows.schema, options=options) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([made.column("block"), pa.array([to.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])


def _unpacked(rows: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(rows.as_buffer()).read_all()


def _block_entries(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    return _entries(((number.as_py(), _unpacked(rows)["text"].to_pylist()) for batch in batches for number, rows in zip(*batch.columns)), bits)


def _target_entries(batches: Iterator[pa.RecordBatch], bits: int, limit: int) -> Iterator[pa.RecordBatch]:
    def blocks() -> Iterator[tuple[None, list[str | None]]]:
        texts: list[str | None] = []
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts.append(text)
                size += len(text or "") + 1
                if size > limit:
                    yield None, texts
                    texts, size = [], 0
        if texts:
            yield None, texts

    return _entries(blocks(), bits)


_ANSWER = "block long, part long, background binary, target binary, words long, background_tokens long, target_tokens long"
_ANSWER_ARROW = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (x.split() for x in _ANSWER.split(", "))])


def _answered(part: int, rows: list[tuple[int | None, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """What one part answers to the (block, keys, counts) that it was asked. The rows are taken from the list."""
    blocks, sizes = [block for block, _, _ in rows], [_length(keys) for _, keys, _ in rows]
    ends = np.cumsum(sizes).tolist()
    keys, counts = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint32)
    for end, size in zip(reversed(ends), reversed(sizes)):
        _, own, many = rows.pop()
        keys[end - size : end] = np.cumsum(_numbers(own), dtype=np.uint64)
        counts[end - size : end] = _numbers(many)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    distinct = len(first) - int((keys[first] == _MARK).any())
    del keys
    place = np.empty(len(order), np.int32)
    place[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(order)))
    counts, asks = counts[order], np.repeat([block is not None for block in blocks], sizes)[order]
    del order
    background, target = (np.add.reduceat(counts * side, first, dtype=np.uint64) for side in (asks, ~asks))
    del counts, asks, first
    out: list[tuple] = []
    if part % 2 == WORDS:
        out.append((None, part, None, None, distinct, int(background.sum()), int(target.sum())))
    held = 0
    for block, end, size in zip(blocks, ends, sizes):
        if block is not None:
            here = place[end - size : end]
            out.append((block, part, _planes(background[here]), _planes(target[here]), None, None, None))
            held += size
        if held > ANSWER_ENTRIES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ANSWER_ARROW)], schema=_ANSWER_ARROW)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ANSWER_ARROW)], schema=_ANSWER_ARROW)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of all blocks for what each block of a part asked about; and, without a block, a part's sums of words.

    A partition holds whole parts, each in a run of rows.
    """
    now, rows = None, []
    for batch in batches:
        for part, block, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now and rows:
                yield from _answered(now, rows)
                rows = []
            now = part
            rows.append((block, keys, counts))
    if rows:
        yield from _answered(now, rows)


def _scored(block: pa.Table, answers: pa.Table, kept: Sequence[str], outcomes: int, totals: tuple[int, int], alpha: float) -> pa.Table:
    """The scores of one block's texts."""
    docs = pa.concat_tables([_unpacked(rows) for rows in block["rows"]])
    words, pairs, bounds = _keys(docs["text"].to_pylist())
    order = np.argsort(answers["part"].to_numpy(), kind="stable")
    parts = answers["part"].to_numpy()
    losses = {}
    distinct, places = {}, {}
    for kind, keys in ((WORDS, words), (PAIRS, pairs)):
        own, places[kind] = np.unique(keys, return_inverse=True)
        distinct[kind] = len(own)
    for side, total in zip(("background", "target"), totals):
        blobs = answers[side].to_pylist()
        counts = {}
        for kind in (WORDS, PAIRS):
            answered = np.concatenate([_numbers(blobs[i]) for i in order if parts[i] % 2 == kind])
            if len(answered) != distinct[kind]:
                raise RuntimeError(f"a block of {distinct[kind]} hashes was answered {len(answered)} counts")
            counts[kind] = answered.astype(np.float64)[places[kind]]
        before = np.concatenate(([0.0], counts[WORDS][:-1]))
        first = bounds[:-1]
        before[first] = counts[WORDS][bounds[1:] - 1]  # the mark before a text is that after it
        one = (counts[WORDS] + 1) / (total + outcomes)
        loss = np.log(before + alpha) - np.log(counts[PAIRS] + alpha * one)
        losses[side] = np.add.reduceat(loss, first) / np.diff(bounds)
    made = {"n_tokens": np.diff(bounds), "ce_target": losses["target"], "ce_background": losses["background"]}
    return pa.table({**{k: docs[k] for k in kept}, **made})


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", keep: Sequence[str] = ("doc_id",),
    alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, part_bits: int = PART_BITS,
) -> DataFrame:
    """`keep`, n_tokens, ce_target, ce_background and score (their difference) of each whole text of the background.

    The hash space has 2 ** part_bits parts or, with more text, as many as keep a part at about PART_ENTRIES hashes.
    """
    small_batches(docs.sparkSession)
    names = [f"__k{i}" for i in range(len(keep))]
    plain = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, names)], F.col(f"`{text}`").alias("text"))
    given = target.select(F.col(f"`{target_text}`").alias("text"))
    size = sum(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for texts in (plain, given))
    bits = max(part_bits, (size // 8 // PART_ENTRIES).bit_length())
    limit = block_bytes if bits == part_bits else max(block_bytes, min((8 * LEAST_ENTRIES) << bits, MOST_BLOCK_BYTES))
    blocks = written(plain.mapInArrow(partial(_packed, limit=limit), "block long, rows binary"), "texts", STORED)
    entry = "part long, block long, keys binary, counts binary"
    asked = blocks.mapInArrow(partial(_block_entries, bits=bits), entry)
    counted = given.mapInArrow(partial(_target_entries, bits=bits, limit=limit), entry)
    dealt = asked.unionAll(counted).repartition(F.col("part")).sortWithinPartitions("part")
    answers = written(dealt.mapInArrow(_answers, _ANSWER), "answers", ANSWERS)
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "background_tokens", "target_tokens")]
    words, *totals = answers.where("block is null").agg(*sums).first()
    fields = [*plain.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("ce_target", "ce_background"))]
    told = answers.where("block is not null").select("block", "part", "background", "target")
    scored = (
        blocks.groupBy("block").cogroup(told.groupBy("block"))
        .applyInArrow(partial(_scored, kept=names, outcomes=words + 2, totals=tuple(totals), alpha=alpha), T.StructType(fields))
    )
    kept = [F.col(n).alias(k) for k, n in zip(keep, names)]
    return scored.select(*kept, "n_tokens", "ce_target", "ce_background", (F.col("ce_target") - F.col("ce_background")).alias("score"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored for their likeness to the assistants' turns of the conversations."""
    target = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    scored = cross_entropy_difference(table(spark, sf_dir, "documents"), target)
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("ce_target", "ce_background", "score")])


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKENS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ \\t\\n\\x0b\\f\\r]+')"

ORACLE_SQL = f"""
WITH texts AS MATERIALIZED (
  SELECT 'b' AS side, doc_id AS id, row_number() OVER () AS r, {_TOKENS} AS words FROM documents
  UNION ALL SELECT 't', NULL, row_number() OVER (), {_TOKENS} FROM conversations WHERE role = 'assistant'),
tokens AS (
  SELECT side, r, unnest(generate_series(1, len(words) + 1)) AS i, unnest(list_append(words, '')) AS w FROM texts),
pairs AS MATERIALIZED (
  SELECT side, r, coalesce(lag(w) OVER (PARTITION BY side, r ORDER BY i), '') AS v, w FROM tokens),
size AS (SELECT count(DISTINCT w) FILTER (w <> '') + 2 AS outcomes FROM pairs),
counted AS MATERIALIZED (SELECT side, v, w, count(*) AS n FROM pairs GROUP BY ALL),
before AS (SELECT side, v, sum(n) AS n FROM counted GROUP BY ALL),
single AS (SELECT side, w, sum(n) AS n FROM counted GROUP BY ALL),
total AS (SELECT s.side, coalesce(sum(n), 0) AS n FROM (VALUES ('b'), ('t')) s(side) LEFT JOIN counted USING (side) GROUP BY ALL),
own AS (SELECT v, w, count(*) AS here, r FROM pairs WHERE side = 'b' GROUP BY ALL),
kinds AS (SELECT DISTINCT v, w FROM own),
losses AS MATERIALIZED (
  SELECT total.side, kinds.v, kinds.w,
    ln(coalesce(b.n, 0) + {ALPHA}) - ln(coalesce(c.n, 0) + {ALPHA} * (coalesce(x.n, 0) + 1) / (total.n + outcomes)) AS loss
  FROM kinds CROSS JOIN total CROSS JOIN size
  LEFT JOIN counted c ON c.side = total.side AND c.v = kinds.v AND c.w = kinds.w
  LEFT JOIN before b ON b.side = total.side AND b.v = kinds.v
  LEFT JOIN single x ON x.side = total.side AND x.w = kinds.w),
scored AS (
  SELECT r, CAST(sum(here) AS BIGINT) AS n_tokens, sum(here * t.loss) / sum(here) AS ce_target, sum(here * b.loss) / sum(here) AS ce_background
  FROM own JOIN losses t ON t.side = 't' AND t.v = own.v AND t.w = own.w
  JOIN losses b ON b.side = 'b' AND b.v = own.v AND b.w = own.w GROUP BY r)
SELECT id AS doc_id, n_tokens, round(ce_target, 6) AS ce_target, round(ce_background, 6) AS ce_background,
       round(ce_target - ce_background, 6) AS score
FROM scored JOIN texts ON texts.side = 'b' AND texts.r = scored.r
"""
