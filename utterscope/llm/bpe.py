"""Byte-level BPE: encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A text is cut at its added tokens, then into the pre-tokenizer's words. The leaves of a word's tree are the ranks of its
adjacent pairs with their places; every node has the least of its leaves, so the root is the leftmost pair of lowest rank.
Merging it changes three leaves, whose paths to the root are made anew, until no pair can be merged. The trees of all new
words of a batch with alike numbers of leaves stand in one array, so that a step merges one pair in each of them; a word of
over LONG_WORD bytes has a tree of its own. Words met before in the worker are looked up; what is kept of them is bounded.

Decoding joins the bytes of the tokens and reads them as UTF-8; what is no UTF-8 becomes U+FFFD.

Defined results: a null text is encoded as empty (no ids) and null ids are decoded as an empty text; added tokens inside
texts are tokens, as the library takes them by default; very long texts are encoded whole, in stretches of WORDS words;
repeated rows are encoded each; an empty table gives an empty result; further columns are not read; an id that the
vocabulary lacks, or null among ids, is left out of the decoded text, as the library does.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.llm.common import small_batches, spread, table
from utterscope.llm.token_count import WHITE, default_vocabulary

#: Words of a text that are looked up at once.
WORDS = 1 << 16
#: New words that are merged at once.
NEW_WORDS = 1 << 14
#: Bytes of a word from which it has a tree of its own.
LONG_WORD = 1 << 10
#: Words, and ids of theirs, that a worker keeps for later texts.
KEPT_WORDS = 400_000
KEPT_IDS = 2_000_000
#: Of a pair that can't be merged. Ranks times places of a shared tree stay below it.
NONE = np.int32(2**31 - 1)
#: The word pattern of byte-level pre-tokenizers. Fixed value; \s is spelled out, as the libraries differ in it.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it can be printed, else the next one from 256 on."""
    printed = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in printed else next(others)) for b in range(256)]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all runs, joined."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Vocabulary:
    """Merges and tokens of a tokenizers file whose model is BPE over bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"]
        odd = [t for t in file["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or file["normalizer"] or odd:
            raise ValueError(f"{path} is no plain byte-level BPE")
        ids, letters = model["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self._key(ids[a], ids[b]) for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))  # of single pairs
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        raw = {i: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for token, i in (ids | self.added).items()}
        tokens = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_sizes = np.array([*map(len, tokens), 0], np.int64)  # the last is of an id that isn't there
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.forget()

    @staticmethod
    def _key(a, b):
        return (a << 24) + b

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.starts_of, self.sizes_of, self.ids_of = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where they can't be merged."""
        keys = self._key(left.astype(np.int64), right.astype(np.int64))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ranks[at], NONE)

    def lookup(self, words: Sequence[str]) -> np.ndarray:
        """Places of the words among those that are kept; new ones are merged first."""
        new = [w for w in dict.fromkeys(words) if w not in self.places]
        if self.places and (len(self.places) + len(new) > KEPT_WORDS or len(self.ids_of) > KEPT_IDS):
            self.forget()
            new = list(dict.fromkeys(words))
        for k in range(0, len(new), NEW_WORDS):
            part = new[k : k + NEW_WORDS]
            ids, sizes = merge_words(self, [w.encode("utf-8", "surrogatepass") for w in part])
            self.places.update(zip(part, range(len(self.places), len(self.places) + len(part))))
            self.starts_of = np.append(self.starts_of, len(self.ids_of) + np.cumsum(sizes) - sizes)
            self.sizes_of, self.ids_of = np.append(self.sizes_of, sizes), np.append(self.ids_of, ids)
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))


def _in_trees(v: Vocabulary, symbols: np.ndarray, leaves: int) -> None:
    """Merge the words in place: `symbols` has a row a word, -1 behind its end, and one more column than leaves."""
    n = len(symbols)
    flat, step = symbols.reshape(-1), leaves + 1
    after = np.tile(np.arange(1, leaves + 2, dtype=np.int32), n)
    before = np.tile(np.arange(-1, leaves, dtype=np.int32), n)
    tree = np.full((n, 2 * leaves), NONE)
    ranks = v.ranks(symbols[:, :-1], symbols[:, 1:])
    tree[:, leaves:] = np.where(ranks == NONE, NONE, ranks * np.int32(leaves) + np.arange(leaves, dtype=np.int32))
    level = leaves // 2
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level //= 2
    nodes = tree.reshape(-1)
    live = np.arange(n)
    while True:
        root = nodes[live * (2 * leaves) + 1]
        more = root != NONE
        live, root = live[more], root[more]
        if not len(live):
            return
        rank, i = np.divmod(root, np.int32(leaves))
        word, top = live * step, live * (2 * leaves)
        j = after[word + i]
        k = after[word + j]
        flat[word + i], flat[word + j] = v.merged[rank], -1
        after[word + i], before[word + k] = k, i
        h = before[word + i]
        first = h < 0
        right = v.ranks(flat[word + i], flat[word + k])
        left = np.where(first, NONE, v.ranks(flat[word + h], flat[word + i]))
        h = np.where(first, j, h)
        changed = np.concatenate([j, i, h]) + np.int32(leaves)
        trees = np.concatenate([top, top, top])
        nodes[trees + changed] = np.concatenate(
            [np.full(len(j), NONE)] + [np.where(r == NONE, NONE, r * np.int32(leaves) + at) for r, at in ((right, i), (left, h))]
        )
        while changed[0] > 1:
            changed >>= 1
            nodes[trees + changed] = np.minimum(nodes[trees + 2 * changed], nodes[trees + 2 * changed + 1])


def _in_one_tree(v: Vocabulary, symbols: list[int]) -> list[int]:
    """The merged symbols of one long word."""
    n = len(symbols)
    leaves = 1 << (n - 1).bit_length()
    none = len(v.keys) * leaves
    rank_of, merged = v.rank_of, v.merged.tolist()

    def leaf(i: int, k: int) -> int:
        rank = rank_of.get(v._key(symbols[i], symbols[k])) if 0 <= i and k < n else None
        return none if rank is None else rank * leaves + i

    tree = [none] * (2 * leaves)
    tree[leaves : leaves + n] = [leaf(i, i + 1) for i in range(n)]
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while tree[1] != none:
        rank, i = divmod(tree[1], leaves)
        j = after[i]
        k = after[i] = after[j]
        before[k], symbols[i], symbols[j] = i, merged[rank], -1
        h = before[i]
        for at, value in ((j, none), (i, leaf(i, k)), (h, leaf(h, i))):
            if at < 0:
                continue
            node = at + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least
    return [s for s in symbols if s >= 0]


def merge_words(v: Vocabulary, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, joined, and the number of ids of each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    starts = np.cumsum(sizes) - sizes
    out, counts = np.full(len(raw), -1, np.int32), np.zeros(len(words), np.int64)
    leaves = np.maximum(2, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    for size in np.unique(leaves[sizes <= LONG_WORD]).tolist():
        at = np.flatnonzero((leaves == size) & (sizes <= LONG_WORD))
        for rows in np.array_split(at, -(-len(at) * size >> 20) or 1):
            inside = np.arange(size + 1) < sizes[rows, None]
            place = (starts[rows, None] + np.arange(size + 1))[inside]
            symbols = np.full((len(rows), size + 1), -1, np.int32)
            symbols[inside] = raw[place]
            _in_trees(v, symbols, size)
            out[place], counts[rows] = symbols[inside], (symbols >= 0).sum(axis=1)
    for row in np.flatnonzero(sizes > LONG_WORD).tolist():
        ids = _in_one_tree(v, raw[starts[row] : starts[row] + sizes[row]].tolist())
        out[starts[row] : starts[row] + len(ids)], counts[row] = ids, len(ids)
    return out[out >= 0], counts


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _stretches(v: Vocabulary, text: str) -> Iterator[list[str] | int]:
    """The text in order: lists of up to WORDS words, and ids of added tokens."""
    at = 0
    for m in [*(v.split.finditer(text) if v.split else ()), None]:
        part = text[at : m.start() if m else len(text)]
        words = (w.group() for w in PATTERN.finditer(part)) if len(part) > WORDS else iter(PATTERN.findall(part))
        while some := list(islice(words, WORDS)):
            yield some
        if m:
            at = m.end()
            yield v.added[m.group()]


def encode_batch(v: Vocabulary, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, joined, and the number of ids of each text. Null is empty."""
    found: list[np.ndarray] = [np.zeros(0, np.int32)]
    counts = np.zeros(len(texts), np.int64)
    words: list[str] = []
    rows: list[tuple[int, int]] = []  # row, words of it among `words`

    def flush() -> None:
        places = v.lookup(words)
        sizes = v.sizes_of[places]
        found.append(gathered(v.ids_of, v.starts_of[places], sizes))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum([n for _, n in rows])
        np.add.at(counts, [r for r, _ in rows], np.diff(upto[ends], prepend=0))
        words.clear()
        rows.clear()

    for row, text in enumerate(texts):
        for part in _stretches(v, text) if text else ():
            if isinstance(part, int):
                if rows:
                    flush()
                found.append(np.array([part], np.int32))
                counts[row] += 1
                continue
            words += part
            rows.append((row, len(part)))
            if len(words) >= WORDS:
                flush()
    if rows:
        flush()
    return np.concatenate(found), counts


def decode_batch(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The text of each run of ids."""
    known = np.where((ids >= 0) & (ids < len(v.token_sizes) - 1), ids, len(v.token_sizes) - 1)
    sizes = v.token_sizes[known]
    raw = gathered(v.token_bytes, v.token_starts[known], sizes).tobytes()
    upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(upto, upto[1:])]


def _mapped(df: DataFrame, column: str, out: str, kind: str, keep: Sequence[str], function: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """`keep`, and the column `out` that `function` makes of `column`, an Arrow batch at a time."""
    small_batches(df.sparkSession)
    kept = df.select(*[F.col(f"`{k}`") for k in keep])
    schema = kept.withColumn(out, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                *others, values = batch.columns
                yield pa.RecordBatch.from_arrays([*others, function(values)], names=[*keep, out])

    return df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{column}`").alias("__values")).mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "ids", path: str | None = None) -> DataFrame:
    """`keep` and the ids of each whole text, an array of int."""
    place = path or default_vocabulary()

    def function(values: pa.Array) -> pa.Array:
        ids, counts = encode_batch(vocabulary(place), values.to_pylist())
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids))

    return _mapped(df, text, out, "array<int>", keep, function)


def decode(df: DataFrame, ids: str = "ids", keep: Sequence[str] = ("doc_id",), out: str = "text", path: str | None = None) -> DataFrame:
    """`keep` and the text of each row's ids."""
    place = path or default_vocabulary()

    def function(values: pa.Array) -> pa.Array:
        counts = np.nan_to_num(values.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = values.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        return pa.array(decode_batch(vocabulary(place), flat, counts), pa.string())

    return _mapped(df, ids, out, "string", keep, function)


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents there and back, as counts and digests."""
    ids = encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    kept = ["doc_id", "n_tokens", "ids_sha256"]
    decoded = decode(ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids"), keep=kept, out="decoded")
    return decoded.select(*kept, F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
