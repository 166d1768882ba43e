"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The words of all benchmark items (A-Z lower-cased) go into one suffix automaton. A document's words are streamed through
it; the automaton keeps the longest match that ends at each word, and from it which windows (10 consecutive item words, or
a whole shorter item) end there and in which items. Words whose neighbours never meet in an item reset the automaton, so a
vectorised pass over the hashed words first finds the runs in which every adjacent pair of words occurs in an item; only
those are streamed. Equal pairs have equal hashes, so the pass loses nothing, and what it lets through by chance the
automaton refuses.

The benchmark is read in parts of at most `part_words` words, one automaton each. Documents are passed by one part at a
time, and what was found is written to the shared checkpoint folder between parts, so what is broadcast and held by a
task at once is bounded; a benchmark of up to `part_words` words takes one pass.

Defined results: null texts have no words; very long texts are scanned whole; an item of no words has no window; a null item_id is written as an empty
string, repeated item_ids count once; repeated documents are scanned each; an empty benchmark hits nothing; an empty table
gives an empty result; further columns are not read by the scan and are kept by `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterscope.llm.arrays import mixed, run_hashes, runs
from utterscope.llm.common import byte_chunks, safe_names, small_batches, table, written

WINDOW = 10
PART_WORDS = 100_000

#: Bytes of words: digits, a-z after lower-casing, and all of other than ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the words of lower-cased UTF-8."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends = runs(_WORD[data]) if len(data) else (np.zeros(0, np.int64),) * 2
    return data, starts, ends


def words_of(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    _, starts, ends = word_bounds(raw)
    return [raw[s:e] for s, e in zip(starts, ends)]


class SuffixAutomaton:
    """Of several sequences; the states know which sequences hold their strings."""

    def __init__(self, sequences: Sequence[Sequence[int]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.items: list[set[int]] = [set() for _ in self.next]
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, sequence in enumerate(sequences):
            state = 0
            for word in sequence:
                state = self.next[state][word]
                up = state
                while up > 0 and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]
            if 0 < len(sequence) < window:
                self.whole[state].append((len(sequence), k))
        #: Short items that are suffixes of a state's strings: its own, then those of its links.
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[state] = (*self.whole[state], *self.short[self.link[state]])

    def _split(self, before: int, word: int) -> int:
        """The state for before's longest string plus word, cloned if the one there also holds longer strings."""
        there = self.next[before][word]
        if self.length[there] == self.length[before] + 1:
            return there
        clone = len(self.next)
        self.next.append(dict(self.next[there]))
        self.link.append(self.link[there])
        self.length.append(self.length[before] + 1)
        self.link[there] = clone
        while before >= 0 and self.next[before].get(word) == there:
            self.next[before][word] = clone
            before = self.link[before]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def stream(self, words: Iterable[int | None]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of the longest match that ends at each word; a None matches nothing."""
        state = length = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield i, state, length

    def windows(self, words: Sequence[int | None]) -> Iterator[tuple[int, int, Iterable[int]]]:
        """(start, end, items) of each window that occurs in the words."""
        for i, state, length in self.stream(words):
            if length >= self.window:
                at = state
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                yield i + 1 - self.window, i + 1, self.items[at]
            if length:
                for size, item in self.short[state]:
                    if size <= length:
                        yield i + 1 - size, i + 1, (item,)


class Matcher:
    """An automaton over word numbers, and the hashes of the adjacent pairs of its words."""

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        self.numbers: dict[bytes, int] = {}
        sequences = [[self.numbers.setdefault(w, len(self.numbers)) for w in words] for _, words in items]
        self.automaton = SuffixAutomaton(sequences, window)
        self.least = min((min(len(s), window) for s in sequences if s), default=0)
        seeds = [np.zeros(0, np.uint64)]
        for _, words in items:
            raw = b" ".join(words)
            data, starts, ends = word_bounds(raw)
            hashes = run_hashes(data, starts, ends)
            seeds.append(hashes if self.least == 1 else pair_hashes(hashes))
        self.seeds = np.unique(np.concatenate(seeds))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.seeds >> np.uint64(44)] = True

    def candidates(self, hashes: np.ndarray, first_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of words that may hold a window; none spans two documents."""
        if not self.least or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = hashes if self.least == 1 else pair_hashes(hashes)
        good = self.sieve[keys >> np.uint64(44)]
        where = np.flatnonzero(good)
        at = np.minimum(np.searchsorted(self.seeds, keys[where]), len(self.seeds) - 1)
        good[where] = self.seeds[at] == keys[where]
        if self.least == 1:  # a run may go on into the next document: every document has its own
            cuts = np.union1d(np.flatnonzero(np.diff(good, prepend=False, append=False)), first_words)
            cuts = cuts[cuts <= len(good)]
            starts, ends = cuts[:-1], cuts[1:]
            return starts[good[starts]], ends[good[starts]]
        inner = first_words[(first_words > 0) & (first_words < len(hashes))]
        good[inner - 1] = False
        starts, ends = runs(good)
        long = ends - starts >= self.least - 1
        return starts[long], ends[long] + 1


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes[:-1] * np.uint64(3) + hashes[1:])


def scan(texts: Sequence[str | None], matchers: Sequence[Matcher]) -> list[tuple[int, list[tuple[int, int, int, int]], list[str]]]:
    """Of each text: its number of words, the hit spans (first and last word + 1, bytes from and to), and the items."""
    found: list[tuple[int, list[tuple[int, int, int, int]], list[str]]] = []
    for _, chunk in byte_chunks(texts):
        raw = b"\n".join(chunk).lower()
        data, starts, ends = word_bounds(raw)
        hashes = run_hashes(data, starts, ends)
        from_byte = np.zeros(len(chunk) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in chunk], out=from_byte[1:])
        first = np.searchsorted(starts, from_byte)
        spans: list[list[tuple[int, int]]] = [[] for _ in chunk]
        items: list[set[str]] = [set() for _ in chunk]
        for matcher in matchers:
            lows, highs = matcher.candidates(hashes, first)
            for low, high, doc in zip(lows.tolist(), highs.tolist(), (np.searchsorted(first, lows, side="right") - 1).tolist()):
                numbers = [matcher.numbers.get(raw[s:e]) for s, e in zip(starts[low:high].tolist(), ends[low:high].tolist())]
                for start, end, own in matcher.automaton.windows(numbers):
                    spans[doc].append((low + start, low + end))
                    items[doc].update(matcher.names[k] for k in own)
        for doc in range(len(chunk)):
            merged = _merged(spans[doc])
            at, base = int(first[doc]), int(from_byte[doc])
            hits = [(s - at, e - at, int(starts[s]) - base, int(ends[e - 1]) - base) for s, e in merged]
            found.append((int(first[doc + 1]) - at, hits, sorted(items[doc])))
    return found


def matchers_of(benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, part_words: int = PART_WORDS) -> Iterator[Matcher]:
    """A matcher for each part of the benchmark of at most `part_words` words (an item of more is a part of its own)."""
    part: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        if part and size + len(words) > part_words:
            yield Matcher(part, window)
            part, size = [], 0
        part.append((row["item"], words))
        size += len(words)
    if part:
        yield Matcher(part, window)


def _passes(context: SparkContext, matchers: Iterator[Matcher]) -> Iterator[tuple[Broadcast | None, bool]]:
    """The broadcast matchers, one at a time, each with whether it is the last; one None for no matcher."""
    now = next(matchers, None)
    while True:
        after = next(matchers, None) if now else None
        yield context.broadcast(now) if now else None, after is None
        if after is None:
            return
        now = after


def _merged(spans: Sequence[tuple[int, int]]) -> list[list[int]]:
    """Spans in order, those that meet made one."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged


_FOUND = ("__words", "__from", "__to", "__items")


def _add_hits(batches: Iterator[pa.RecordBatch], shared: Broadcast | None, kept: Sequence[str], last: bool) -> Iterator[pa.RecordBatch]:
    """The hits of one part put to those of earlier parts; the text goes on unless this part is the last."""
    matchers = [shared.value] if shared else []
    for batch in batches:
        if not batch.num_rows:
            continue
        old = batch.to_pydict() if "__from" in batch.schema.names else None
        rows = []
        for i, (n, spans, items) in enumerate(scan(batch.column("__text").to_pylist(), matchers)):
            own = [(s, e) for s, e, _, _ in spans]
            if old:
                own = _merged([*own, *zip(old["__from"][i], old["__to"][i])])
                items = sorted({*items, *old["__items"][i]})
            rows.append((n, [s for s, _ in own], [e for _, e in own], items))
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
        made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        names = [*kept, *([] if last else ["__text"])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, *_FOUND])


def _with_hits(now: DataFrame, keep: Sequence[str], passes: Iterator[tuple[Broadcast | None, bool]], keep_text: bool = False) -> DataFrame:
    """`keep` and the hits of all parts in the unchanged text `__text`, which goes on only with `keep_text`."""
    for shared, last in passes:
        drop = last and not keep_text
        fields = [*(now.schema[c] for c in keep), *([] if drop else [now.schema["__text"]]), T.StructField("__words", T.LongType())]
        fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("__from", "__to")] + [T.StructField("__items", T.ArrayType(T.StringType()))]
        now = now.mapInArrow(partial(_add_hits, shared=shared, kept=list(keep), last=drop), T.StructType(fields))
        if not last:
            now = written(now, "hits")
    return now


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """`keep`, n_words, n_hit, n_items, items_sha256, contaminated and longest (words of the longest hit span)."""
    small_batches(docs.sparkSession)
    passes = _passes(docs.sparkSession.sparkContext, matchers_of(benchmark, window=window, part_words=part_words))
    now = _with_hits(docs.select(*keep, F.col(text).alias("__text")), keep, passes)
    lengths = F.zip_with("__to", "__from", lambda e, s: e - s)
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)
    return now.select(
        *keep, F.col("__words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce(F.array_max(lengths), F.lit(0)).alias("longest"),
    )


def _without(text: str, spans: Sequence[tuple[int, int, int, int]]) -> str:
    raw, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
    for _, _, s, e in spans:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def _cut_hits(batches: Iterator[pa.RecordBatch], shared: Broadcast | None, max_span: int, text: str) -> Iterator[pa.RecordBatch]:
    """Texts without the hits of the only part, cut until nothing is left to cut: what a cut brings together may be a window."""
    matchers = [shared.value] if shared else []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.schema.names.index(text)
        out = batch.column(place).to_pylist()
        first = scan(out, matchers)
        words = [n for n, _, _ in first]
        hits = [sum(e - s for s, e, _, _ in spans) for _, spans, _ in first]
        todo, found = list(range(len(out))), first
        while todo:
            changed = []
            for i, (_, spans, _) in zip(todo, found):
                spans = [x for x in spans if x[1] - x[0] > max_span]
                if spans:
                    out[i] = _without(out[i], spans)
                    changed.append(i)
            todo, found = changed, scan([out[i] for i in changed], matchers)
        columns = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(hits, pa.int64())], names=[*batch.schema.names, "__words", "__hit"])


def _cut_found(batches: Iterator[pa.RecordBatch], kept: Sequence[str], max_span: int) -> Iterator[pa.RecordBatch]:
    """Texts without the spans that all parts found, cut once, and whether that changed them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts, changed = [], []
        for text, lows, highs in zip(*(batch.column(c).to_pylist() for c in ("__text", "__from", "__to"))):
            spans = [(s, e) for s, e in zip(lows, highs) if e - s > max_span]
            if spans:
                _, starts, ends = word_bounds(text.encode("utf-8", "surrogatepass").lower())
                text = _without(text, [(s, e, int(starts[s]), int(ends[e - 1])) for s, e in spans])
            texts.append(text)
            changed.append(bool(spans))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(changed)], names=[*kept, "__text", "__changed"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5, part_words: int = PART_WORDS) -> DataFrame:
    """The rows whose hits cover at most `max_coverage` of their words, without the hit spans of over `max_span` words.

    All columns stay; texts without such spans, null among them, are unchanged. Hits of all parts of the benchmark are found
    in the same text, which is cut then; texts that were cut are passed by all parts again until none finds anything.
    """
    small_batches(docs.sparkSession)
    plain, names = safe_names(docs)
    context = docs.sparkSession.sparkContext
    parts = lambda: _passes(context, matchers_of(benchmark, window=window, part_words=part_words))
    shared, only = next(parts())
    if only:
        schema = T.StructType([*plain.schema.fields, T.StructField("__words", T.LongType()), T.StructField("__hit", T.LongType())])
        now = plain.mapInArrow(partial(_cut_hits, shared=shared, max_span=max_span, text=names[text]), schema)
        return now.where(F.col("__hit") <= max_coverage * F.col("__words")).select(*[F.col(n).alias(c) for c, n in names.items()])
    kept = [n for c, n in names.items() if c != text]
    now = plain.withColumnRenamed(names[text], "__text")
    schema = T.StructType([*(now.schema[c] for c in (*kept, "__text")), T.StructField("__changed", T.BooleanType())])
    hit = F.aggregate(F.zip_with("__to", "__from", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, n: a + n)
    done = None
    while True:
        found = _with_hits(now, kept, parts(), keep_text=True)
        if done is None:
            found = found.where(hit <= max_coverage * F.col("__words"))
        passed = written(found.mapInArrow(partial(_cut_found, kept=kept, max_span=max_span), schema), "cut")
        same = passed.where("not __changed").drop("__changed")
        done = same if done is None else done.unionByName(same)
        now = passed.where("__changed").drop("__changed")
        if now.isEmpty():
            return done.select(*[F.col("__text" if c == text else n).alias(c) for c, n in names.items()])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
items AS (SELECT item, w, least({WINDOW}, len(w)) AS k FROM b WHERE len(w) > 0),
windows AS MATERIALIZED (
  SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN sizes)),
found AS MATERIALIZED (SELECT DISTINCT r, item, i, k FROM places JOIN windows USING (k, s)),
hit AS MATERIALIZED (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found)),
runs AS (SELECT r, count(*) AS n FROM (SELECT r, p - row_number() OVER (PARTITION BY r ORDER BY p) AS g FROM hit) GROUP BY r, g),
sums AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_hit, max(n) AS longest FROM runs GROUP BY r),
own AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest
FROM d LEFT JOIN sums USING (r) LEFT JOIN own USING (r)
"""
