"""Spelling variants: anagram hashing over the words of a corpus.

A word's key is the sum of the fifth powers of its letters' code points (modulo 2**64), so the key of a word without one
letter is its key less one power. Two words that differ by one letter share such a key: a word less a letter has the key of
the word that lacks it, and two words that exchange a letter have equal keys less the one and the other. A word so has a key
a distinct letter, however long it is. As one letter can only be in one half, keys are joined together with a hash of the
half that must be alike: the first half of what both words share, or the rest of it. What meets is verified, letters in
order, by an edit distance of one; a pair counts in the first half's bucket if that half is alike, otherwise in the other's,
so it is found exactly once. Of words in a bucket all have one half and the letters of the other half in common.

A word's form is its near word of largest n if that is at least FACTOR times its own. Forms grow by that factor at each step,
so chains are short (14 steps at 10^11 occurrences), and doubling the steps finds every root in a few joins.

Defined results: null texts have no words; a null id is empty in the hash that deletes letters; very long texts and runs are
taken whole; repeated rows count each; ties go to the smaller word by code points; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.llm.common import table, written
from utterscope.llm.sharding import _CRC, _STEP

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5

_MASK = (1 << 64) - 1


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run, less one letter where a hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    less = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    return F.when(h % EVERY == 0, less).otherwise(run)


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_COUNT) -> DataFrame:
    """word and n of every word of LEAST_LENGTH letters or more that occurs `least` times or more."""
    runs = docs.select(F.col(f"`{key}`").alias("key"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({LETTERS})"), 1)).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LENGTH).withColumn("run", F.translate("run", UPPER, LOWER))
    words = runs.select(misspelt(F.col("key"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _signed(x: int) -> int:
    return ((x + (1 << 63)) & _MASK) - (1 << 63)


def buckets(word: str) -> Iterator[tuple[int, int, int, bool, bool]]:
    """(key, hash of the half, length of the first half, whether it is the first, whether the word is whole)."""
    n = len(word)
    powers = {c: ord(c) ** 5 for c in set(word)}
    total = sum(word.count(c) * p for c, p in powers.items())
    for c, power in [(None, 0), *powers.items()]:
        shared = n if c is None else n - 1
        half = shared // 2
        for first, there in ((True, c is None or word.rindex(c) >= half), (False, c is None or word.index(c) < half)):
            if there:
                part = word[:half] if first else word[n - shared + half :]
                yield _signed(total - power), _signed(xxhash.xxh64_intdigest(f"{shared}:{first}:{part}")), half, first, c is None


def with_buckets(words: DataFrame) -> DataFrame:
    """word and n in every bucket of the word."""
    names = ["key", "half_hash", "half", "first", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                found = [list(buckets(w)) for w in part.column(0).to_pylist()]
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                made = list(zip(*(b for f in found for b in f)))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([c.take(rows) for c in part.columns] + [pa.array(m, t) for m, t in zip(made, kinds)], names=["word", "n", *names])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long, half_hash long, half int, first boolean, whole boolean")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all words that differ by one letter, each pair once, in no particular direction."""
    found = with_buckets(words)
    b = found.select("key", "half_hash", "whole", F.col("word").alias("other"), F.col("n").alias("other_n"))
    a = found.where(~F.col("whole")).drop("whole")
    alike = F.col("word").substr(F.lit(1), F.col("half")) == F.col("other").substr(F.lit(1), F.col("half"))
    return (
        a.join(b, ["key", "half_hash"])
        .where((F.col("whole") | (F.col("word") < F.col("other"))) & (alike == F.col("first")))
        .where(F.levenshtein("word", "other", 1) == 1)
        .select("word", "n", "other", "other_n")
    )


def with_forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """The words with n_near, form and form_n."""
    there = F.struct(F.col("word"), F.col("other"), F.col("other_n"))
    back = F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = near_pairs(words).select(F.inline(F.array(there, back)))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    )
    joined = words.join(best, "word", "left")
    common = -F.col("best.less") >= factor * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("best.form")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"),
    )


def with_roots(forms: DataFrame, factor: int = FACTOR) -> DataFrame:
    """The rows with root: the last word that forms lead to, the word itself if it has none. `forms` is read several times."""
    links = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most, steps = forms.agg(F.max("n")).first()[0] or 0, 0
    while most >= factor:
        most, steps = most // factor, steps + 1
    for _ in range((steps - 1).bit_length() if steps > 1 else 0):  # steps double
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("__next", "root").alias("root")), "roots")
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = written(word_counts(table(spark, sf_dir, "documents")), "words")
    return with_roots(written(with_forms(words), "forms")).select("word", "form", "root", "n", "n_near", "form_n")


#: Near words by the words that letters' places leave, where the query has keys of letters.
ORACLE_SQL = f"""
WITH RECURSIVE
steps AS (SELECT list(step ORDER BY i) AS steps FROM (SELECT i, {_STEP.format("i")} AS step FROM range(256) x(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{LETTERS}')), '{UPPER}', '{LOWER}') AS run FROM documents),
counted AS (
  SELECT run, concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run) AS t, count(*) AS k FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, k, {_CRC} AS h FROM counted CROSS JOIN steps),
spelt AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, p, substr(word, 1, p) || substr(word, p + 2) AS s FROM (SELECT word, CAST(unnest(range(length(word))) AS INTEGER) AS p FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM less a JOIN less b USING (p, s) WHERE a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON s = words.word
  UNION SELECT words.word, less.word FROM less JOIN words ON s = words.word),
best AS (
  SELECT near.word, count(*) AS n_near, min({{'less': -o.n, 'form': other}}) AS best FROM near JOIN words o ON other = o.word GROUP BY near.word),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {FACTOR} * n THEN best.form END AS form,
    CASE WHEN -best.less >= {FACTOR} * n THEN -best.less END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT chain.word, form FROM chain JOIN formed ON formed.word = chain.root WHERE form IS NOT NULL),
roots AS (SELECT chain.word, root FROM chain JOIN formed ON formed.word = root WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
