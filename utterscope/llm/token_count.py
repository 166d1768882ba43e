"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are encoded by the library in batches balanced by their UTF-8 bytes. A text of over LONG_BYTES is split at safe
boundaries, and its count is the sum over the pieces. Safe are places over which the byte-level pre-tokenizer never joins
characters: before white space that follows another character, and between a letter and a digit; none is taken inside an
added token's text. No text is truncated. A piece without a safe boundary is encoded whole, so a task holds one batch or the
longest stretch of a text without white space, and without a letter beside a digit.

Defined results: a null text counts as empty (0 bytes, 0 tokens); very long texts are counted whole; repeated rows are
counted each; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import partial

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from utterscope.llm.common import map_texts, spread, table

#: Unicode White_Space, as the pre-tokenizer's \s has it. Fixed values.
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
BOUNDARY = regex.compile(rf"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=\p{{L}})(?=\p{{N}})|(?<=\p{{N}})(?=\p{{L}})")
BATCH_BYTES = 256 << 10
LONG_BYTES = 64 << 10

_encoders: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _encoders[path] = made
    return _encoders[path]


def added_tokens(path: str) -> regex.Pattern | None:
    """What matches the texts that the library takes as tokens of their own."""
    found = [t.content for t in encoder(path).get_added_tokens_decoder().values()]
    return regex.compile("|".join(map(regex.escape, sorted(found, key=len, reverse=True)))) if found else None


def split_long(text: str, limit: int, added: regex.Pattern | None) -> list[str]:
    """Pieces of at least `limit` characters, up to a safe boundary."""
    inside = [m.span() for m in added.finditer(text)] if added else []
    pieces, at, k = [], 0, 0
    for m in iter(lambda: BOUNDARY.search(text, at + limit), None):
        cut = m.start()
        while k < len(inside) and inside[k][1] <= cut:
            k += 1
        if k < len(inside) and inside[k][0] < cut:  # the next boundary after the added token
            found = BOUNDARY.search(text, inside[k][1])
            if not found:
                break
            cut = found.start()
            if any(s < cut < e for s, e in inside[k:]):
                break  # added tokens side by side: the rest stays whole
        pieces.append(text[at:cut])
        at = cut
    return [*pieces, text[at:]]


def byte_batches(pieces: Sequence[tuple[int, str, int]], limit: int) -> Iterator[list[tuple[int, str, int]]]:
    """Runs of (row, piece, bytes) of about `limit` bytes each."""
    batches = max(1, round(sum(n for _, _, n in pieces) / limit))
    least = sum(n for _, _, n in pieces) / batches
    batch, size, done = [], 0, 1
    for piece in pieces:
        batch.append(piece)
        size += piece[2]
        if size >= least * done and done < batches:
            yield batch
            batch = []
            done += 1
    if batch:
        yield batch


def count_tokens(texts: Sequence[str | None], path: str, long_bytes: int = LONG_BYTES, batch_bytes: int = BATCH_BYTES) -> tuple[list[int], list[int]]:
    """UTF-8 bytes and token counts of whole texts; null is empty."""
    encode, added = encoder(path).encode_batch_fast, added_tokens(path)
    sizes, counts = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], [0] * len(texts)
    pieces: list[tuple[int, str, int]] = []
    for row, (text, size) in enumerate(zip(texts, sizes)):
        if size > long_bytes:
            pieces += [(row, p, len(p.encode("utf-8", "surrogatepass"))) for p in split_long(text, long_bytes, added)]
        elif size:
            pieces.append((row, text, size))
    for batch in byte_batches(pieces, batch_bytes):
        for (row, _, _), encoding in zip(batch, encode([p for _, p, _ in batch], add_special_tokens=False)):
            counts[row] += len(encoding)
    return sizes, counts


def _columns(texts: Sequence[str | None], path: str, limit: int) -> dict[str, Sequence]:
    sizes, counts = count_tokens(texts, path)
    return {"n_bytes": sizes, "n_tokens": counts, "over_limit": [n > limit for n in counts]}


def token_counts(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None, limit: int = 512) -> DataFrame:
    """`keep`, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_texts(docs, text, partial(_columns, path=path or default_vocabulary(), limit=limit), fields, keep)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
